"""Divergence of the sources of a language, by baseline and corrections.

All numbers are whole: a term's share in a group is ``1 + floor(SCALE * (count +
SMOOTH) / (total + SMOOTH * terms))``, and two groups differ by the sum of the
absolute differences of their shares over all kept terms of the language.

Nearly all counts are zero, so no group is laid out over all terms.  A pair
starts at (kept terms) x (difference of the shares of a zero count).  Terms that
one side has correct that by what they add if the other side had none: this
depends on the side's share alone, so a source sends a row for each different
count.  Terms that both have correct it once more, from the inverted index: the
postings of a term meet by (language, term), and only corrections other than 0
are sent.

Texts are counted in bounded tables inside the tasks before anything is
shuffled, so neither a frequent term nor a source with a third of all rows is
one task's work.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Documents of its language that must hold a term.
LEAST_DOCUMENTS = 30
SCALE, SMOOTH = 1_000_000_000, 5
#: Ranks of the terms that are reported.
TERMS = 50
#: Entries of a task's tables after which they are sent on.
HELD = 500_000
#: Sources of a language in one part of its pairs.
PART = 256

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text: runs of letters A-Z (lower-cased) and of all characters beyond ASCII."""
    return text.translate(_TERM).split()


_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(tables: dict) -> pa.RecordBatch:
    keys = [(k, t) for k, (n, _) in tables.items() for t in n]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k, _ in keys], pa.string()),
            pa.array([k[1] for k, _ in keys], pa.string()),
            pa.array([t for _, t in keys], pa.binary()).cast(pa.string()),
            pa.array([c for n, _ in tables.values() for c in n.values()], pa.int64()),
            pa.array([d[t] for n, d in tables.values() for t in n], pa.int64()),
        ],
        names=["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, of one task's rows or a part of them."""
    tables: dict = defaultdict(lambda: (Counter(), Counter()))
    held = 0
    for batch in batches:
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            n, docs = tables[lang[i], source[i]]
            found, before = terms(text.as_py()), len(n)
            n.update(found)
            docs.update(set(found))
            held += len(n) - before
            if held > HELD:
                yield _counted(tables)
                tables.clear()
                held = 0
    yield _counted(tables)


def _share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """Share of a term, as a whole number; null where the language keeps no term."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    down = F.nullif(wide(total) + wide(kept) * SMOOTH, F.lit(0))
    return (F.call_function("div", (wide(count) + SMOOTH) * SCALE, down) + 1).cast("long")


def _differ(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.select("lang", "source", "item", "value", rank.alias("rank"))
    out = out.filter(F.col("rank") <= most) if most else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _all_pairs(groups: DataFrame) -> DataFrame:
    """``(lang, a, b, za, zb, kept)``: each source of a language with each other one, as the report lists them.

    A language's sources are dealt in parts, so a language with most of them
    isn't one task.  ``za`` and ``zb`` are the shares of a zero count.
    """
    parts = groups.groupBy("lang").agg(F.ceil(F.count("*") / PART).alias("parts"))
    g = groups.join(parts, "lang")
    a = g.select("lang", F.pmod(F.xxhash64("source"), "parts").alias("part"), F.col("source").alias("a"), F.col("zero").alias("za"), "kept")
    b = g.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("source").alias("b"), F.col("zero").alias("zb"))
    return a.join(b, ["lang", "part"]).filter("a <> b").drop("part")


def _pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: difference of each ordered pair of sources."""
    pairs = cut(_all_pairs(groups), "pairs")
    base = F.col("kept") * F.coalesce(_differ("za", "zb"), F.lit(0))
    started = pairs.select("lang", "a", "b", base.alias("value"))

    # A source's different shares, as many as different counts.
    profile = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    profile = profile.groupBy("lang", F.col("source").alias("a")).agg(F.collect_list(F.struct("p", "m")).alias("shares"))
    corrected = F.aggregate(
        "shares", F.lit(0).cast("long"), lambda s, x: s + x["m"] * (F.abs(x["p"] - F.col("zb")) - _differ("za", "zb"))
    )
    alone = pairs.join(profile, ["lang", "a"]).select("lang", "a", "b", corrected.alias("value")).filter("value <> 0")

    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    both = x.join(y, ["lang", "term"]).filter("a < b")
    again = _differ("pa", "pb") - _differ("pa", "zb") - _differ("za", "pb") + _differ("za", "zb")
    both = both.select("lang", "a", "b", again.alias("value")).filter("value <> 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    turned = [df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for df in (alone, both)]
    total = started.union(alone).union(both).union(turned[0]).union(turned[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) of ``docs``.

    Part ``pair`` has each other source of the language with the sum of the
    differences of all kept terms; part ``term`` the ``top`` terms whose share in
    the source is most above that in its language.  A term is kept if at least
    ``least`` rows of its language hold it.  Null text, lang and source count as
    empty; a group without any term is there with its pairs.  Each row counts as
    a document, rows that repeat too.  Equal values are ranked by item, bytewise.
    Columns other than text, lang and source are ignored.  A source alone in its
    language has no pair; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = docs.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = cut(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"))
    kept = cut(kept.filter(F.col("docs") >= least).select("lang", "term", "all"), "kept")
    index = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "index")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(index.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"]).withColumn("zero", _share(F.lit(0), "total", "kept"))
    groups = cut(groups, "groups")

    shares = index.join(groups, ["lang", "source"])
    shares = shares.select("lang", "source", "term", "zero", _share("n", "total", "kept").alias("p"), _share("all", "lang_total", "kept").alias("q"))
    postings = cut(shares, "postings")
    above = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(_pair_values(groups, postings), "pair").union(_ranked(above, "term", top))
