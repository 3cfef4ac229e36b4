"""Token files and WARC bundles: round trips, random access, checksums."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import seekable, tokens, warc
from quillon.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return tokens.Encoder(f.read())


TEXTS = st.text(alphabet=st.sampled_from("aBz'19 .,!?\n\t\r\x0b\xa0\x85 　éß漢😀<|>end"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_slices_encode_like_whole_texts(plain, encoder, texts):
    got = encoder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_texts_encode_like_the_library(plain, encoder):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f" {end}", f"a  {end}  b", f"x\n {end}\n y", f"{end}{end}", f"a{end}b <|endoftext| >", "no token", f"é {end} 漢", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    assert 50256 in want[0]


def test_real_texts_encode_like_the_library(spark, plain, encoder):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n: int, first: int = 0) -> str:
    return "".join("ab"[(i.bit_count() + first) % 2] for i in range(n))


def test_complementary_words_encode_apart(plain, encoder):
    """Words that hashes by polynomials modulo a power of 2 can't tell apart."""
    texts = [f"x {thue_morse(n, k)} y" for n in (256, 1024, 2048, 4096) for k in (0, 1)]
    for batch in (texts, texts[::-1], [" ".join(texts)]):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in batch])] == [plain.encode(t, add_special_tokens=False).ids for t in batch]


def test_slices_of_one_hash_are_told_apart_by_their_bytes(plain, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        blind = tokens.Encoder(f.read())
    monkeypatch.setattr(tokens, "hash_slices", lambda raw, lo, hi: np.array([3, 5], dtype=np.uint64)[(hi - lo) % 2])
    for t in ("a house", "a mouse", "a house a mouse", "some other words stand here", ""):
        assert blind.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_shards_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 1000)
    docs = spark.createDataFrame([(i, "word " * 40) for i in range(60)], "doc_id long, text string")
    assert tokens.write_tokens(docs, str(tmp_path), PATH).count() > 8


def test_a_full_cache_starts_anew(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SLICES", 20)
    with open(PATH, encoding="utf-8") as f:
        small = tokens.Encoder(f.read())
    rng = random.Random(1)
    for _ in range(10):
        t = " ".join(f"word{rng.randrange(30)}" for _ in range(15))
        assert small.encode([t.encode()])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def expected_tokens(plain, rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_every_document_in_order(spark, plain, tmp_path):
    rows = [(i, f"document {i} " * (i % 40)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x y " * 90_000), (203, "same"), (203, "same"), (None, "no id")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    out = tokens.token_output(df, PATH, f"file://{tmp_path}/t")
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == expected_tokens(plain, rows)
    assert not [f for f in os.listdir(tmp_path / "t") if f.endswith(".tmp")]


def test_no_documents_no_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_output(df, PATH).collect() == []


def test_readers_decompress_only_wanted_documents(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_IDS", 50)
    rows = [(i, f"text number {i} " * 6) for i in range(60)]
    written = tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"file://{tmp_path}/t", PATH, shards=1)
    assert written.count() == 1
    read = []
    original = seekable.Reader.frame
    monkeypatch.setattr(seekable.Reader, "frame", lambda self, k: read.append(k) or original(self, k))
    found = dict(tokens.read_shard(tokens.shard_uri(f"file://{tmp_path}/t", 0), wanted={7, 41}))
    assert {d: x.tolist()[:-1] for d, x in found.items()} == {d: plain.encode(rows[d][1], add_special_tokens=False).ids for d in (7, 41)}
    assert len(read) <= 2


@pytest.fixture
def file(tmp_path):
    w = seekable.Writer(f"file://{tmp_path}/x.zst")
    contents = [b"first" * 100, b"", os.urandom(5000)]
    for c in contents:
        w.frame(c)
    w.close(seekable.join_index([b"a", b"", b"index"]))
    return tmp_path / "x.zst", contents


def test_frames_and_index_round_trip(file):
    path, contents = file
    r = seekable.Reader(str(path))
    assert [r.frame(k) for k in (2, 0, 1)] == [contents[k] for k in (2, 0, 1)]
    assert r.frames == 3 and seekable.split_index(r.index) == [b"a", b"", b"index"]
    r.close()


def test_any_zstandard_reader_reads_the_frames(file):
    import io

    import zstandard

    path, contents = file
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read() == b"".join(contents)


def test_damage_is_found(file):
    path, _ = file
    raw = bytearray(path.read_bytes())
    r = seekable.Reader(str(path))
    at = r._at[2] + 40  # inside the third frame, which can't be compressed
    r.close()
    raw[at] ^= 1
    path.write_bytes(raw)
    damaged = seekable.Reader(str(path))
    assert damaged.frame(0)
    with pytest.raises(Exception):
        damaged.frame(2)
    path.write_bytes(raw[:-3])
    with pytest.raises(Exception):
        seekable.Reader(str(path))


PAGES = "page_id long, url string, html string, digest int"


def test_warc_rows(spark):
    long, other = "<p>" + "é" * 60, "y" * 100
    rows = [(5, "u", long, 1), (3, "u 3", long, 1), (9, None, long, 1), (4, "a", "tiny", 1), (6, "b", "tiny", 1), (7, "c", None, 1), (8, "c", "", 1),
            (None, "n", long, 1), (10, "d", other, 1), (10, "d", other, 1), (11, "e", "z" * 99, 1), (12, "e", "z" * 99, 1)]
    out = warc.warc_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert {p: (r.record_type, r.refers_to) for p, r in by.items()} == {
        5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 4: ("response", None), 6: ("response", None), 7: ("response", None),
        8: ("response", None), None: ("response", None), 10: ("response", None), 11: ("response", None), 12: ("response", None),
    }
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        assert (by[page].payload_bytes, by[page].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_records_are_found_by_identifier(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 60, 0) for i in range(50)]
    folder = f"file://{tmp_path}/w"
    written = warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), folder).collect()
    wanted = {warc.record_uri(17), warc.record_uri(44)}
    found = [x for w in written for x in warc.read_bundle(warc.bundle_uri(folder, w.part), wanted)]
    assert sorted((h["warc-record-id"].strip("<>"), b.decode()) for h, b in found) == sorted((warc.record_uri(i), rows[i][2]) for i in (17, 44))
    for head, _ in found:
        assert head["warc-type"] == "response" and head["content-type"].startswith("application/http; msgtype=response") and head["warc-date"]


def test_a_line_break_in_a_url_stays_in_its_header():
    record = warc.make_record(1, "http://x/\r\nWARC-Type: y", b"z", "d", None)
    head, block = warc.parse_record(record)
    assert head["warc-type"] == "response" and block == b"z" and "\n" not in head["warc-target-uri"]


def test_workers_forget_the_encoder_with_the_next_stage(spark, tmp_path):
    """Workers are used again; the slices that an encoder keeps must not take memory from other stages."""
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('some words ', id) AS text")

    def held(batches):
        from quillon.llm import tokens

        for batch in batches:
            yield batch.from_pydict({"n": [len(tokens._ENCODERS)]})

    for k in range(2):
        assert tokens.write_tokens(rows, f"file://{tmp_path}/{k}", PATH, shards=4).count() == 4
        assert {r.n for r in spark.range(0, 8, 1, 4).mapInArrow(held, "n long").collect()} == {0}
