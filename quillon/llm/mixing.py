"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same rate, the source's target over its
size.  Whole copies are taken outright; the fraction is an inclusion
probability, and the cube method turns probabilities into 0 or 1 while it keeps
the number of documents and the number of words of the source balanced: a
vector of probabilities moves along the null space of the balancing constraints
until a unit reaches 0 or 1.

Equal rows are one unit: m of them take the whole part of m times the rate
outright, and the rest is the unit's probability.  So no block holds more than
one of them, however often a row is repeated.

The flight phase runs in blocks of bounded size inside each source.  A block
leaves at most as many undecided units as there are constraints; these form the
blocks of the next round, until one block a source is left.  There a few units of
all sizes and the flight's rest land: all their choices are tried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Weights of the sources in order of name (code points, null last), repeating.
WEIGHTS = (1, 2, 3)
#: No source's target exceeds this multiple of its size.
MOST = 3.0
#: Units of a block of the flight phase.
BLOCK = 4096
#: Units that the last block of a source leaves for the landing, besides the flight's rest.
LANDING = 12
SEED = 6
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)``: all words shared by weight, capped.

    ``sizes`` has one row a source.  What a capped source can't take goes to the
    others by weight.  That has a closed form: in order of cap over weight, the
    first k sources are capped for the least k that leaves the rest under its
    share.  One row a source passes through a single task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double")
    w = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    w = w.withColumn("level", level)
    # The level at the first source that isn't capped holds for all after it.
    open_level = F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)
    return w.withColumn("at", open_level["level"]).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("at")), F.col("cap")).alias("target")
    )


def _seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but two at most are 0 or 1.

    Balanced are the count (constraint vector p) and the words (p times size);
    three undecided units at a time leave a null space of one dimension.
    """
    out = p.astype(float).copy()
    scale = float(size.max(initial=0)) or 1.0
    u = rng.random(len(p) + 3).tolist()
    active: list[int] = []
    for i in np.flatnonzero((out > _EPS) & (out < 1 - _EPS)).tolist():
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        sa, sb, sc = size[a] / scale, size[b] / scale, size[c] / scale
        v = [sc - sb, sa - sc, sb - sa]  # keeps the sum and the weighted sum
        if not any(v):
            v = [1.0, -1.0, 0.0]
        up = down = np.inf
        for k, d in zip(active, v, strict=True):
            x = out[k]
            if d > 0:
                up, down = min(up, (1 - x) / d), min(down, x / d)
            elif d < 0:
                up, down = min(up, x / -d), min(down, (1 - x) / -d)
        step = up if u[i] * (up + down) < down else -down
        left = []
        for k, d in zip(active, v, strict=True):
            out[k] = x = out[k] + step * d
            if x <= _EPS:
                out[k] = 0.0
            elif x >= 1 - _EPS:
                out[k] = 1.0
            else:
                left.append(k)
        active = left
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few open units: of all choices the one nearest to the expected words and number."""
    out = p.copy()
    rest = np.flatnonzero((out > _EPS) & (out < 1 - _EPS))
    if len(rest):
        choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
        words = np.abs(choices @ size[rest] - out[rest] @ size[rest])
        number = np.abs(choices.sum(axis=1) - out[rest].sum())
        out[rest] = choices[np.argmin(words + number * size[rest].mean() / 100)]
    return np.round(out)


def _fly(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size", "g"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(_seed(seed, *key))
        size = pdf["size"].to_numpy(dtype=float)
        p = pdf["p"].to_numpy(dtype=float).copy()
        if pdf["blocks"].iloc[0] > 1:
            p = flight(p, size, rng)
        else:  # the last block of its source: a few units of all sizes are left for the landing
            some = np.argsort(size, kind="stable")[np.unique(np.linspace(0, len(p) - 1, LANDING).astype(int))]
            fly = np.setdiff1d(np.arange(len(p)), some)
            p[fly] = flight(p[fly], size[fly], rng)
            p = land(p, size)
        pdf["p"] = p
        return pdf[["doc_id", "source", "size", "h", "g", "m", "whole", "p"]]

    return run


_UNIT = "doc_id long, source string, size long, h long, g long, m long, whole long, p double"


def _round(units: DataFrame, seed: int) -> DataFrame:
    """One flight over blocks of at most about ``BLOCK`` units of a source each."""
    n = units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    units = units.join(F.broadcast(n) if n.count() <= 10_000 else n, units.source.eqNullSafe(n.source)).drop(n.source)
    units = units.withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("blocks")))
    return units.groupBy("source", "block").applyInPandas(_fly(seed), _UNIT)


def copies(units: DataFrame, seed: int = SEED) -> DataFrame:
    """``units`` (doc_id, source, size, h, g, m, rate) with the whole number of copies of all ``m`` rows of a unit."""
    expected = F.col("m") * F.col("rate")
    whole = F.floor(expected + _EPS).cast("long")
    units = units.select("doc_id", "source", "size", "h", "g", "m", whole.alias("whole"), F.greatest(expected - whole, F.lit(0.0)).alias("p"))
    certain = units.filter(F.col("p") <= _EPS).withColumn("p", F.lit(0.0))
    done, open_ = [certain], units.filter(F.col("p") > _EPS)
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        flown = cut(_round(open_, seed), "flight")
        done.append(flown.filter(~undecided))
        open_ = flown.filter(undecided)
        if not open_.take(1):
            break
        seed += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "h", "g", "m", (F.col("whole") + F.round("p").cast("long")).alias("copies"))


def _plan(rows: DataFrame) -> DataFrame:
    """``(doc_id, source, size, h, g, m, source_size, target, copies)`` of each group of equal rows (doc_id, source, size, h, g)."""
    units = cut(rows.groupBy("doc_id", "source", "size", "h", "g").agg(F.count("*").alias("m")), "sizes")
    targets = cut(source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))), "targets")
    t = targets.withColumnRenamed("source", "_s")
    rated = units.join(t, units.source.eqNullSafe(t._s)).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chosen = copies(rated.select("doc_id", "source", "size", "h", "g", "m", rate.alias("rate")))
    return chosen.join(t, chosen.source.eqNullSafe(t._s)).drop("_s")


def _sized(columns: list[str]) -> list[Column]:
    """Columns doc_id, source and size of documents, ``h`` that orders the draws, and ``g``, a hash of the given columns."""
    return [
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("h"),
        F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("g"),
    ]


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row.

    A row's size is its number of words; a null text has none, and takes none
    whatever its copies are.  A null source is a source of its own.  Rows
    without doc_id take part as all others.  Draws depend on doc_id, source,
    text and a seed only, so reruns agree; of repeated rows, which one is taken
    makes no difference.  Without any words all targets are 0.
    """
    plan = _plan(docs.select(_sized(["doc_id", "source", "text"])))
    each = F.floor(F.col("copies") / F.col("m")).cast("long")
    more = F.col("copies") - each * F.col("m")  # so many of the equal rows are taken once more than the others
    out = plan.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).withColumn("copies", each + (F.col("i") <= more).cast("long"))
    return out.select(
        "doc_id", "source", "size", "h", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken.

    Columns beyond doc_id, source and text may have any name and stay as they
    are.  Rows that are equal in all columns are one group: pre-aggregated to
    one row and repeated as often as the group is taken.
    """
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    marked = docs.select(*_sized(hashed), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = _plan(marked.select("doc_id", "source", "size", "h", "g")).filter("copies > 0").select(F.col("doc_id").alias("id"), F.col("g").alias("g2"), "copies")
    one = marked.groupBy("doc_id", "g").agg(F.first("row").alias("row"))
    out = one.join(taken, one.doc_id.eqNullSafe(taken.id) & (one.g == taken.g2))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
