"""Language and quality models: held-out accuracy, and the code lengths by their definition."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, quality

SF = "/root/testdata/sf0.01"


def crc(doc_id: int, m: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % m


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = langid.identify_languages(docs).collect()
    assert len(out) == len(truth) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    sure = [r for r in held if r.score > 0.9]
    assert len(sure) > len(held) / 2 and np.mean([r.lang_pred == truth[r.doc_id] for r in sure]) > 0.98


def test_only_the_text_is_read_in_predictions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": -F.col("doc_id") - 1})
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(docs, model).collect()}
    b = {-r.doc_id - 1: (r.lang_pred, r.score) for r in langid.predict_languages(other, model).collect()}
    assert a == b


def test_odd_texts_and_tables(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, "der Hund und die Katze " * 3, "de", 1) for i in range(9)] + [(i, "the dog and the cat " * 3, "en", 1) for i in range(20, 29)]
    odd = [(100, None, "de", 1), (101, "", "en", 1), (102, "12 34 !?", None, 1), (None, "the cat and the dog", None, 1), (103, "der und die " * 30_000, None, 1)]
    out = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows + odd, schema)).collect()}
    assert {d: out[d].lang_pred for d in (100, 101, 102, None, 103)} == {100: "und", 101: "und", 102: "und", None: "en", 103: "de"}
    assert out[None].held_out is False and out[100].score == 0
    assert langid.identify_languages(spark.createDataFrame([], schema)).collect() == []
    unlabelled = langid.identify_languages(spark.createDataFrame([(1, "some text", None, 1)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def ppm_bits(train: list[bytes], text: bytes) -> float:
    """Code length by the definition: escapes with exclusion, order 3 down to 256 equal bytes."""
    counts: dict = defaultdict(Counter)
    for t in train:
        s = b"\n\n\n" + t.lower()
        for i in range(3, len(s)):
            for k in range(4):
                counts[s[i - k : i]][s[i]] += 1

    def p(context: bytes) -> list[float]:
        below = p(context[1:]) if context else [1 / 256] * 256
        c = counts.get(context, Counter())
        if not c:
            return below
        n, d = sum(c.values()), len(c)
        left = sum(below[y] for y in range(256) if y not in c)
        escape = d / (n + d) if left > 0 else 0.0
        return [c[x] / n * (1 - escape) if x in c else escape * below[x] / left for x in range(256)]

    s = b"\n\n\n" + text.lower()
    return -sum(math.log2(p(s[i - 3 : i])[s[i]]) for i in range(3, len(s)))


@pytest.mark.parametrize("chunk", [1 << 20, 7])
@pytest.mark.parametrize("letters", ["abc d", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400)) + "ab "])
def test_code_lengths_follow_the_definition(monkeypatch, letters, chunk):
    """Also over a script whose characters take far more than 96 bytes, and over texts cut in pieces."""
    rng = random.Random(4)
    train = ["".join(rng.choices(letters, k=60)).encode() for _ in range(12)]
    model = langid.build_model({"x": langid.gram_counts(train)})
    monkeypatch.setattr(langid, "CHUNK_BYTES", chunk)
    texts = [b"abc dd a", b"cabz Q", b"", b"bbbbbbbb", "aéb一丁".encode(), train[3] + train[5]]
    for t, bits in zip(texts, model.code_lengths(texts)[:, 0], strict=True):
        assert bits == pytest.approx(ppm_bits(train, t), rel=1e-4)


def test_many_bytes_are_told_apart():
    """Languages of one script that differ in rare bytes only."""
    rng = random.Random(2)
    common = [chr(c) for c in range(0x4E00, 0x4F00)]
    own = {"x": [chr(c) for c in range(0x5E00, 0x5E80)], "y": [chr(c) for c in range(0x5E80, 0x5F00)]}
    write = lambda lang, n: "".join(rng.choice(own[lang]) if rng.random() < 0.2 else rng.choice(common) for _ in range(n)).encode()
    model = langid.build_model({x: langid.gram_counts([write(x, 200) for _ in range(40)]) for x in own})
    for lang in own:
        assert (model.code_lengths([write(lang, 60) for _ in range(20)]).argmin(axis=1) == model.languages.index(lang)).all()


def test_probabilities_sum_to_one_in_every_context(monkeypatch):
    monkeypatch.setattr(langid, "CONTEXTS", 20)
    rng = random.Random(9)
    model = langid.build_model({x: langid.gram_counts(["".join(rng.choices("abcdef ", k=60)).encode() for _ in range(10)]) for x in "xy"})
    rest = 256 - int(model.symbol.max())
    for tree in model.trees:
        p = np.exp2(-tree.bits.astype(float))
        p[:, -1] *= rest
        assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and len(p) == p.shape[1] + 40


def test_every_prediction_is_the_shortest_code(spark):
    """The query's rows against code lengths by the definition, on a small table."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices({"x": "aab c", "y": "abbd "}[lang], k=rng.randint(1, 30))), lang) for i in range(60) for lang in ["xy"[i % 2]]]
    out = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = {x: [t.encode() for i, t, lang in rows if lang == x and crc(i, 3) != 1] for x in "xy"}
    for i, t, _ in rows:
        bits = {x: ppm_bits(train[x], t.encode()) for x in "xy"}
        if t.strip() and abs(bits["x"] - bits["y"]) > 1e-3:
            assert out[i].lang_pred == min(bits, key=bits.get)


def auc(score, label) -> float:
    score, label = np.asarray(score), np.asarray(label)
    good, bad = score[label == 1], score[label == 0]
    return float((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert auc(*zip(*held, strict=True)) > 0.9
    # Calibrated: the mean score is near the share of label 1.
    assert np.mean([s for s, _ in held]) == pytest.approx(np.mean([y for _, y in held]), abs=0.12)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_scores_are_those_of_the_plain_formula(spark):
    """Every score from the model's dictionaries, block by block, with the library alone."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit_quality(docs, labels)
    size = {}
    for name, content in (("good", m.good), ("bad", m.bad)):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
        size[name] = lambda t, c=c: sum(len(c.compress(t[i : i + 2048])) for i in range(0, len(t), 2048))
    text = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    for r in quality.quality_scores(docs, labels).collect()[:300]:
        t = text[r.doc_id]
        feature = (size["bad"](t) - size["good"](t) + m.mean * quality.PRIOR_BYTES) / (len(t) + quality.PRIOR_BYTES)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(m.slope * feature + m.offset))), abs=1e-9)


def test_long_labelled_texts_are_learned_from(spark):
    """All labelled texts are long: nothing is left out by its length."""
    rows = [(i, ("good words here stand so " if i % 2 else "zz qq xx yy ") * 4000) for i in range(24)]
    short = [(100, "good words here stand so " * 8), (101, "zz qq xx yy " * 8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.quality_scores(spark.createDataFrame(rows + short, "doc_id long, text string"), labels).collect()}
    assert out[100] > 0.5 > out[101]


def test_quality_of_odd_rows_and_tables(spark):
    docs = "doc_id long, text string, score int"
    marks = "doc_id long, quality int"
    rows = [(i, ("good words here " if i % 2 else "zz qq xx ") * 20, 1) for i in range(60)] + [(None, "good words", 1), (70, None, 1), (71, "", 1), (71, "", 1), (72, "good " * 60_000, 1)]
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (5, None), (None, 1), (999, 1), (7, 9)]
    out = quality.quality_scores(spark.createDataFrame(rows, docs), spark.createDataFrame(labels, marks)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[9].score > by[8].score and by[70].score == by[71].score and by[None].held_out is False
    none = spark.createDataFrame([], marks)
    assert {r.score for r in quality.quality_scores(spark.createDataFrame(rows, docs), none).collect()} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], docs), none).collect() == []
    one_class = quality.quality_scores(spark.createDataFrame(rows, docs), spark.createDataFrame([(i, 1) for i in range(9)], marks)).collect()
    assert len({r.score for r in one_class}) == 1 and one_class[0].predicted == 1
