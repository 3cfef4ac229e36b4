"""Mixing, n-gram scores and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprint, mixing, ngram_lm

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_AZ))


# Mixing


def targets_of(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        share = {s: rest * weight[s] / w for s in names if s not in capped} if w else {}
        over = [s for s, x in share.items() if x > 3 * sizes[s]]
        if not over:
            return {**share, **capped}
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize(
    "sizes", [{"a": 100, "b": 5, "c": 900, None: 1}, {"a": 1}, {"z": 10, "B": 10, "é": 10, "漢": 1000}, {"a": 0, "b": 50}, {f"s{i}": i * i for i in range(20)}]
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets_of(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r["size"] for r in rows} == {d: len(words_of(t)) for d, t in text.items()}
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    want = targets_of({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in x) == pytest.approx(want[s], rel=0.02)


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, taken int"
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "c", None, 1), (2, None, "y", 1), (3, "  ", "y", 1), (4, "w " * 5000, "z", 1)]
    out = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    assert all(r.target == 0 and r.taken == 0 for r in out if r.source == "y")
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert all(r.taken == 0 for r in mixing.mix(spark.createDataFrame(rows[3:5], schema)).collect())


def test_mixed_documents_repeat_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == want


def test_many_equal_rows_and_clashing_names(spark):
    """Equal rows are one unit; columns with the names that the operator uses stay as they are."""
    schema = "doc_id long, text string, source string, h int, g int, m int, row string, copies int, _n int"
    rows = [(None, None, None, 1, 2, 3, "r", 4, 5)] * 500 + [(7, "a b c", "x", 1, 2, 3, "r", 4, 5)] * 400 + [(7, "a b c", "x", 9, 2, 3, "r", 4, 5)] * 3
    rows += [(100 + i, "w " * (i % 50), "yz"[i % 2], i, 2, 3, "r", 4, 5) for i in range(200)]
    docs = spark.createDataFrame(rows, schema)
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows) and max(r.copies for r in plan) <= 3
    same = [r.copies for r in plan if r.doc_id == 7]
    assert max(same) - min(same) <= 1 and sum(r.taken for r in plan if r.source == "x") == pytest.approx(next(r.target for r in plan if r.source == "x"), rel=0.02)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    got = Counter(map(tuple, got.collect()))
    assert got.keys() <= set(rows)
    assert {k: sum(n for r, n in got.items() if r[:3] == k) for k in {r[:3] for r in rows}} == {
        k: sum(r.copies for r in plan if (r.doc_id, r.source) == (k[0], k[2])) for k in {r[:3] for r in rows}
    }


def test_flight_keeps_both_totals_and_rates():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 3000, 500).astype(float)
    mean = np.zeros(500)
    for i in range(200):
        p = mixing.flight(np.full(500, 0.37), size, np.random.default_rng(i))
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        assert p.sum() == pytest.approx(0.37 * 500) and p @ size == pytest.approx(0.37 * size.sum())
        mean += p / 200
    assert abs(mean - 0.37).max() < 0.16  # 4.6 standard deviations of 200 draws


# N-gram scores


def lm_brute_force(rows):
    count, total = Counter(), 0
    tokens = [(d, zlib.crc32(str(d).encode()) % 10 == 0 if d is not None else False, [*words_of(t), None]) for d, t in rows]
    for _, held, ts in tokens:
        if not held:
            count.update(ts)
            total += len(ts)
    base = lambda ts: sum(math.log10((count[t] + 0.1) / (total + 0.1 * (len(count) + 1))) for t in ts)
    return sorted((d, held, len(ts), sum(count[t] > 0 for t in ts), total, round(base(ts), 6)) for d, held, ts in tokens)


def test_counts_and_base_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900_001, None), (900_002, ""), (900_003, " \t"), (900_004, "ÄB äb Ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    out = ngram_lm.lm_scores(df).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == lm_brute_force(rows)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in out)


def test_the_mixture_is_the_stated_one(spark, monkeypatch):
    """Scores of a small corpus from dictionaries and the learned weights; they sum to one over all next tokens."""
    learned = {}
    original = ngram_lm.learn_weights
    monkeypatch.setattr(ngram_lm, "learn_weights", lambda cells, distinct: learned.setdefault("w", original(cells, distinct)))
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcde", weights=[8, 4, 2, 1, 1], k=rng.randint(0, 12)))) for i in range(200)]
    out = {r.doc_id: r for r in ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = learned["w"]
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0
    one, two, start = Counter(), Counter(), 0
    for d, t in rows:
        if not out[d].held_out:
            ts = [*words_of(t), None]
            one.update(ts)
            two.update(zip(["<s>", *ts[:-1]], ts))
            start += 1
    total = sum(one.values())

    def p(h, t):
        seen = start if h == "<s>" else one[h]
        k = w[ngram_lm.bucket_of(np.array([seen]))[0]]
        return k[0] * two[h, t] / max(seen, 1) + k[1] * one[t] / total + k[2] / (len(one) + 1)

    for d, t in rows:
        ts = [*words_of(t), None]
        assert out[d].score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["<s>", *ts[:-1]], ts)))
    for h in ["<s>", "a", "e"]:
        assert sum(p(h, t) for t in one) + p(h, "unseen") == pytest.approx(1)


@pytest.mark.parametrize("fan", [2, 3])
def test_an_exchange_of_many_levels_gives_the_same(spark, monkeypatch, fan):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"t{k}" for k in range(40)], k=rng.randint(0, 30)))) for i in range(300)] + [(None, "same row")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    read = lambda: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 6)) for r in ngram_lm.lm_scores(df).collect())
    want = read()
    monkeypatch.setattr(ngram_lm, "FANOUT", fan)
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 300)
    assert ngram_lm.Exchange(40).levels >= 4
    assert read() == want


def test_messages_grow_in_proportion():
    for blocks in (10, 256, 257, 5000, 70_000):
        x = ngram_lm.Exchange(blocks)
        assert x.fan <= ngram_lm.FANOUT and x.fan**x.levels >= blocks
    x = ngram_lm.Exchange(300)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    asked = x.send(299, 0, True, [(keys, np.ones(5000, np.uint64), np.zeros(5000, np.uint64))] * 2)
    assert asked.num_rows == x.fan and set(asked.column("node").to_pylist()) == {x.fan + d for d in range(x.fan)}
    assert np.array_equal(np.concatenate([ngram_lm._unpack_keys(k.as_py()) for k in asked.column("word_keys")]), keys)


def test_counts_above_32_bits():
    """Sums of messages whose counts exceed 2**32, up to the answers."""
    x = ngram_lm.Exchange(2)
    keys = np.array([5, 1 << 60], dtype=np.uint64)
    n = np.array([3 << 32, 7], dtype=np.uint64)
    asks = [x.send(b, 0, b == 1, [(keys, n, n if b == 1 else n * np.uint64(0))] * 2) for b in (0, 1)]
    import pyarrow as pa

    asked = pa.concat_tables(asks)
    answer = x.answer((pa.scalar(0),), asked.filter(pa.compute.equal(asked.column("node"), 0)))
    assert ngram_lm.unpack(answer.column("word_n")[0].as_py()).tolist() == [6 << 32, 14]
    assert ngram_lm.unpack(answer.column("word_part")[1].as_py()).tolist() == [3 << 32, 7]
    assert answer.column("n_tokens")[0].as_py() == (6 << 32) + 14 and answer.column("n_fold")[0].as_py() == (3 << 32) + 7
    rng = np.random.default_rng(2)
    for high in (1, 1 << 8, 1 << 40, (1 << 64) - 1):
        v = rng.integers(0, high, 99, dtype=np.uint64)
        assert np.array_equal(ngram_lm.unpack(ngram_lm.pack(v)), v)


def test_complementary_words_are_counted_apart(spark):
    rows = [(i, "".join("ab"[(k.bit_count() + i) % 2] for k in range(2048))) for i in range(1, 4)]
    out = ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == lm_brute_force(rows)


def test_lm_of_odd_tables(spark):
    schema = "doc_id long, text string, score int"
    assert ngram_lm.lm_scores(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = ngram_lm.lm_scores(spark.createDataFrame([(held, "never seen", 1)], schema)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    out = ngram_lm.lm_scores(spark.createDataFrame([(None, "a a", 1), (None, "a a", 1), (1, "long " * 50_000, 1)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in out) == [(0, 3, 3), (0, 3, 3), (1, 50_001, 50_001)]


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(3)
    p2, p1 = rng.dirichlet(np.ones(50) * 0.1), rng.dirichlet(np.ones(50))
    true = 0.7 * p2 + 0.2 * p1 + 0.1 / 51
    n = rng.multinomial(200_000, true / true.sum()).astype(float)
    keep = n > 0
    cells = np.column_stack([np.full(50, 5.0), np.round(np.log(p2)), np.round(np.log(p1)), n, n * np.log(p2), n * np.log(p1)])[keep]
    assert np.allclose(ngram_lm.learn_weights(cells, 50)[5], [0.7, 0.2, 0.1], atol=0.04)


# Fingerprints


def test_edited_texts_and_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()} | {10**6: None, 10**6 + 1: "", 10**6 + 2: "Zeile 漢😀", 10**6 + 3: "x" * 200_000}
    df = spark.createDataFrame([(d, t, 1) for d, t in text.items()], "doc_id long, text string, h int")
    out = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert out.keys() == text.keys()
    ids = sorted(text, reverse=True)
    for d, after in zip(ids, [*ids[1:], ids[0]]):
        t, u, r = text[d] or "", text[after] or "", out[d]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == u:
            assert r.near_next == 1 and r.fingerprint == out[after].fingerprint
    alike = [r for d, r in out.items() if text[d] and len(text[d]) > 500 and len(set(text[d])) > 5]
    assert np.mean([r.near_edited for r in alike]) > 2 * np.mean([r.near_next for r in alike])


def test_equal_texts_have_equal_prints_whatever_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(50)], k=30)) for _ in range(10)]
    rows = [(i * 37 % 1009, rng.choice(texts)) for i in range(100)] + [(None, texts[0]), (5000, texts[1]), (5000, texts[1])]
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    known = {}
    lookup = dict((d, t) for d, t in rows)
    for r in out:
        assert known.setdefault(lookup[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(known.values())) == len(known)
    assert [r.near_next for r in out if r.doc_id is None] == [0.0]
    assert fingerprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_lexicon_is_the_band(spark):
    texts = [f"common word{i} " + ("often" if i % 20 == 0 else "") + (" pair" if i < 2 else "") for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = fingerprint.lexicon(df)
    slot = {t: spark.sql(f"select pmod(xxhash64('{t}'), {fingerprint.SLOTS}) s").first().s for t in ("common", "word7", "often", "pair")}
    assert {t: bool(table[s // 7] >> s % 7 & 1) for t, s in slot.items()} == {"common": False, "word7": False, "often": True, "pair": True}
