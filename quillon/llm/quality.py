"""Quality by compression: zstandard dictionaries of good and of bad texts.

A text is cut into blocks; each block is compressed once with the dictionary of
good and once with that of bad labelled texts.  The difference of the two
compressed sizes, divided by the text's length, is the only feature.  Blocks
keep the dictionaries at work through long texts: a whole document would soon
compress against itself.  A logistic curve, fitted on labelled texts that the
dictionaries haven't seen, turns the feature into the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches

#: Labelled texts of each class that are learned from, of any length: the bound of the sample.
SAMPLE_ROWS = 3000
#: Blocks of a class's texts from which its dictionary is built.
DICTIONARY_BLOCKS = 8192
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 2048
LEVEL = 3
#: Bytes of average text that each text counts as having besides its own, so
#: that a few words decide little.
PRIOR_BYTES = 200
PREDICT_AT = 0.3
#: Rows whose crc32(doc_id) modulo this is 0 are held out.
HOLD_OUT = 5


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and a logistic curve; ``score`` depends on the text only."""

    good: bytes
    bad: bytes
    mean: float
    slope: float
    offset: float

    def scorer(self) -> "_Sizes":
        return _Sizes(self.good, self.bad)

    def score(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * feature + self.offset, -50, 50)))


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self._by = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self._by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> int:
        good, bad = (c.compress for c in self._by)
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return sum(len(bad(b)) - len(good(b)) for b in blocks)

    def features(self, texts: list[bytes], mean: float) -> np.ndarray:
        n = np.array([len(t) for t in texts], dtype=float)
        return (np.array([self.difference(t) for t in texts], dtype=float) + mean * PRIOR_BYTES) / (n + PRIOR_BYTES)


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, lightly regularised, by Newton steps."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (w * (y - p)) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b[0] / scale, b[1]


def fit_quality(docs: DataFrame, labels: DataFrame, hold_out: int = HOLD_OUT) -> QualityModel:
    """Learn from labelled rows that aren't held out.

    ``SAMPLE_ROWS`` texts of each class, chosen by a hash of doc_id, are learned
    from; one half gives the dictionaries, the other one the curve.  They stay
    with the executors: the driver gets ``DICTIONARY_BLOCKS`` blocks of a class
    and one number a text.  Class frequencies are counted over all labelled
    rows.  Null labels are ignored; conflicting labels of a doc_id count as the
    least.  Without labels of both classes every text gets the frequency of
    label 1 (0.5 without any label).
    """
    marks = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
        .filter(crc_mod(F.col("doc_id"), hold_out) != 0)
    )
    count = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    texts = texts.withColumn("t", F.xxhash64("text"))
    # Far more ids than needed are drawn before the texts are read, as not every label has a usable text.
    drawn = marks.filter(
        " OR ".join(f"(y = {y} AND pmod(xxhash64(doc_id), 1000003) < {min(1.0, 4 * SAMPLE_ROWS / n) * 1000003:.0f})" for y, n in count.items()) or "false"
    )
    # About 4 * SAMPLE_ROWS ids of each class, whatever the corpus is: a bounded broadcast, no text moves.
    rows = texts.join(F.broadcast(drawn), "doc_id").select("y", "doc_id", "t").distinct()
    picked = [
        (r["doc_id"], r["t"], y, k % 2)
        for y in sorted(count)
        for k, r in enumerate(rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(SAMPLE_ROWS).collect())
    ]
    if not all((y, k) in {p[2:] for p in picked} for y in (0, 1) for k in (0, 1)):
        total = sum(count.values())
        share = min(max(count.get(1, 0) / total, 0.01), 0.99) if total else 0.5
        return QualityModel(b"\n", b"\n", 0.0, 0.0, float(np.log(share / (1 - share))))
    spark = docs.sparkSession
    sample = texts.join(F.broadcast(spark.createDataFrame(picked, "doc_id long, t long, y int, half int")), ["doc_id", "t"])
    sample = cut(sample.dropDuplicates(["doc_id", "t"]), "labelled")

    # The texts' blocks, cut as they are cut for scoring.
    raw = F.encode("text", "utf-8")
    places = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / BLOCK_BYTES).cast("int"))
    blocks = sample.filter("half = 0").select("y", "doc_id", "t", raw.alias("raw"), F.explode(places).alias("k"))
    blocks = blocks.select("y", F.xxhash64("doc_id", "t", "k").alias("h"), F.substring(F.col("raw"), F.col("k") * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)).alias("block"))
    good, bad = (
        _dictionary([bytes(r["block"]) for r in blocks.filter(F.col("y") == y).orderBy("h", "block").limit(DICTIONARY_BLOCKS).collect()]) for y in (1, 0)
    )
    dictionaries = spark.sparkContext.broadcast((good, bad))

    def differences(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(*dictionaries.value)
        for part in parts:
            texts = [t.encode("utf-8", "replace") for t in part["text"]]
            yield pd.DataFrame({"y": part["y"], "h": part["h"], "d": [float(sizes.difference(t)) for t in texts], "n": [float(len(t)) for t in texts]})

    held = sample.filter("half = 1").select("y", F.xxhash64("doc_id", "t").alias("h"), "text")
    numbers = held.mapInPandas(differences, "y int, h long, d double, n double").toPandas().sort_values(["h", "y", "d", "n"])
    y, d, n = (numbers[c].to_numpy(dtype=float) for c in "ydn")
    total = sum(count.values())
    w = np.where(y == 1, count[1] / (y == 1).sum(), count[0] / (y == 0).sum()) / total
    mean = float((w * d / n).sum())
    slope, offset = _logistic((d + mean * PRIOR_BYTES) / (n + PRIOR_BYTES), y, w * len(y))
    return QualityModel(good, bad, mean, float(slope), float(offset))


def quality_of(spark: SparkSession, text: Column, model: QualityModel) -> Column:
    """Score of a text column (null: empty)."""
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        sizes = m.scorer()
        for text in parts:
            raw = [(t or "").encode("utf-8", "replace") for t in text]
            yield pd.Series(m.score(sizes.features(raw, m.mean)))

    return quality(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    A null text is the empty one; empty texts score as an average text.  A null
    doc_id isn't held out.  Columns beyond doc_id and text are never read.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False))
    score = quality_of(docs.sparkSession, F.col("text"), fit_quality(docs, labels))
    out = docs.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.select("*", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
