"""MinHash near-duplicates by min-max hashing, confirmed on whole shingle sets.

Under each permutation both the least and the greatest value of a document's
shingle hashes are kept, so ``PERMUTATIONS`` evaluations give twice as many
signature values.  Bands take values of different permutations only, minima and
maxima apart, so that the values of a band are independent.

1. One pass over the texts: shingle sets, a 128-bit key of each set, signature,
   bands.  Documents of equal sets form a class, named by its least doc_id; a
   class of any size is one node from here on.
2. Every bucket of a band links its least class with its other classes (a star,
   not all pairs); links hold if the whole sets reach the threshold.
3. Stars can miss a link between two other members.  In buckets that still hold
   several components other members lead a second star, each band's own choice;
   this joins nearly all of a large group.
4. Buckets that then still hold several components are compared in full: in
   blocks, by signature, without pairs that are already connected.  A pair is
   named by the first of the buckets that it shares; what comes near the
   threshold is confirmed on the whole sets as well.
5. Connected components over all links.

With 5 values a band and 40 bands a pair at the threshold 0.75 shares no bucket
with a chance of 2e-5, at 0.8 of 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import connected_components
from .words import grams, hash_words, mix

SHINGLE = 5
#: Similarity of 75 % as a fraction of whole numbers.
THRESHOLD = (75, 100)
BAND = 5
BANDS = 40
#: Permutations whose values form the bands (minima and maxima), and all of them.
BANDED = BAND * BANDS // 2
PERMUTATIONS = 2 * BANDED
#: Rows of one side of a block of comparisons.
BLOCK = 1024
#: Standard deviations below the threshold at which a signature still counts as near.
SIGMAS = 4
#: Parts of a class of equal sets.
CLASS_PARTS = 32
#: Members that are confirmed against one leader in one go.
STAR_ROWS = 512

_ODD = np.random.default_rng(20).integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, ascending, of one document's word hashes."""
    return np.unique(grams(h, SHINGLE))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a set under all permutations of 32-bit hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 2048):
        p = np.multiply.outer(_ODD, x[i : i + 2048])
        np.minimum(low, p.min(axis=1), out=low)
        np.maximum(high, p.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """Bucket keys, one a band, of each row of signatures."""
    banded = np.concatenate([signatures[:, :BANDED], signatures[:, PERMUTATIONS : PERMUTATIONS + BANDED]], axis=1)
    v = banded.reshape(len(signatures), BANDS, BAND).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND):
            out = mix(out * np.uint64(0x100000001B3) + v[:, :, k])
    return out.view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            h, off = hash_words(_texts(batch.column("text")))
            n, keys, rows, sigs = [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(h[off[i] : off[i + 1]])
                n.append(len(s))
                if len(s):
                    sums = np.array([mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], dtype=np.uint64)
                    rows.append(i)
                    keys.append(sums.tobytes())
                    sigs.append(signature(s))
            key: list = [None] * batch.num_rows
            sig: list = [None] * batch.num_rows
            band: list = [None] * batch.num_rows
            if rows:
                m = np.array(sigs)
                for i, k, b, g in zip(rows, keys, bands_of(m), m.astype(np.uint8), strict=True):
                    key[i], band[i], sig[i] = k, b, g.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())),
                    pa.array(sig, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )


_SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"


_PAIRS = "a long, b long, n long"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (a, part, b, text), the leader (b null) first in each (a, part)."""
    at, leader = None, np.empty(0, np.uint64)
    up, down = THRESHOLD
    for batch in batches:
        a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
        h, off = hash_words(_texts(batch.column("text")))
        out_a, out_b = [], []
        for i in range(batch.num_rows):
            s = shingle_set(h[off[i] : off[i + 1]])
            if b[i] is None:
                at, leader = (a[i], part[i]), s
            elif at == (a[i], part[i]) and min(len(s), len(leader)) * down >= max(len(s), len(leader)) * up:
                common = len(np.intersect1d(s, leader, assume_unique=True))
                if down * common >= up * (len(s) + len(leader) - common):
                    out_a.append(a[i])
                    out_b.append(b[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows (a, b, n) whose whole sets reach the threshold.

    ``n`` is the size of a bucket that made the pair.  It tells in how many parts
    the pairs of ``a`` are dealt, so pairs never meet by ``a`` alone: a part gets
    at most about ``STAR_ROWS`` members from each of a leader's bands.
    """
    parts = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.max("n") / STAR_ROWS))).cast("long"))
    pairs = pairs.groupBy("a", "b").agg(parts.alias("parts"))
    pairs = cut(pairs.select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"), "pairs")
    members = pairs.join(texts, pairs.b == texts.c).select("a", "part", "b", "text")
    leaders = (
        pairs.select("a", "part").distinct().join(texts, F.col("a") == texts.c)
        .select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    )
    dealt = members.union(leaders).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return cut(dealt.mapInArrow(_confirm, "a long, b long"), "confirmed")


def _least_likeness(values: int) -> float:
    """Share of equal signature values below which a pair isn't near."""
    share = THRESHOLD[0] / THRESHOLD[1]
    least = share - SIGMAS * (share * (1 - share) / values) ** 0.5
    return least + (1 - least) / 256  # values are kept as single bytes


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (a, b, n, sig_a, sig_b) with near signatures."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            near = (x == y).mean(axis=1) >= _least_likeness(x.shape[1])
            yield batch.select(["a", "b", "n"]).filter(pa.array(near))


def _second_stars(members: DataFrame, roots: DataFrame, sigs: DataFrame) -> DataFrame:
    """Near pairs of a leader, chosen anew in each bucket, with other components' members."""
    m = members.join(roots, members.c == roots.node, "left").select("band", "c", F.coalesce("root", "c").alias("root"))
    lead = m.groupBy("band").agg(
        F.min_by(F.struct("c", "root"), F.xxhash64("c", "band")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")
    ).filter("lo <> hi")
    pairs = m.join(lead, "band").filter("root <> lead.root").select(F.least("c", "lead.c").alias("a"), F.greatest("c", "lead.c").alias("b"), "n")
    pairs = cut(pairs.groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")
    x = sigs.select(F.col("c").alias("a"), F.col("sig").alias("sig_a"))
    y = sigs.select(F.col("c").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "sig_a", "sig_b").mapInArrow(_alike, _PAIRS)


def _near(pdf):
    """Near pairs (a, b, n) of one block of a bucket: rows (band, n, x, y, side, c, root, sig, bands)."""
    import pandas as pd

    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), -1)
    bands = np.stack(pdf["bands"].to_numpy())
    c, root, side = pdf["c"].to_numpy(), pdf["root"].to_numpy(), pdf["side"].to_numpy()
    here = int(np.flatnonzero(bands[0] == pdf["band"].iloc[0])[0])
    alone = pdf["x"].iloc[0] == pdf["y"].iloc[0]
    first = np.flatnonzero(side == 0)
    other = first if alone else np.flatnonzero(side == 1)
    least = _least_likeness(sig.shape[1])
    out_a, out_b = [], []
    for i in first:
        rest = other[(root[other] != root[i]) & ((c[other] > c[i]) | (not alone))]
        if len(rest):
            rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= least]
            rest = rest[~(bands[rest, :here] == bands[i, :here]).any(axis=1)]
            out_a.append(np.minimum(c[i], c[rest]))
            out_b.append(np.maximum(c[i], c[rest]))
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
    return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": pdf["n"].iloc[0]})


def _remaining(members: DataFrame, roots: DataFrame, sigs: DataFrame) -> DataFrame:
    """Near pairs of different components that share a bucket."""
    m = members.join(roots, members.c == roots.node, "left").select("band", "c", F.coalesce("root", "c").alias("root"))
    open_ = m.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    m = m.join(open_.select("band", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "band").join(sigs, "c")
    # A row meets its own block and all others: it goes to each pair of blocks that holds its own.
    m = m.withColumn("own", F.pmod(F.xxhash64("c"), "blocks"))
    m = m.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.select(
        "band", "n", "c", "root", "sig", "bands",
        F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side"),
    )
    return m.groupBy("band", "x", "y").applyInPandas(_near, _PAIRS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Reads the columns doc_id and text; others may be there and are ignored.  A
    null or blank text has the empty set and is linked with nothing, as is a
    row without doc_id (it is kept, with a null component).  Rows that share a
    doc_id count as one document.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(docs.mapInArrow(_sketch, _SKETCH), "sketch")

    # A class is pre-aggregated in parts, and its documents learn its name by part: a
    # class that holds a third of all rows isn't one task's work.
    live = sketch.filter("set_key is not null and doc_id is not null").select("doc_id", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(CLASS_PARTS)).alias("part"))
    parts = cut(live.groupBy("set_key", "part").agg(F.min("doc_id").alias("c")), "parts")
    classes = cut(parts.groupBy("set_key").agg(F.min("c").alias("c")), "classes")
    names = classes.select("c").distinct()
    reps = sketch.join(names, sketch.doc_id == names.c).dropDuplicates(["c"]).select("c", "bands", "sig")

    banded = reps.select("c", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("c").alias("leader"), F.max("c").alias("last"), F.count("*").alias("n")).filter("leader <> last")
    members = cut(banded.join(buckets.select("band", "leader", "n"), "band").select("band", "c", "leader", "n"), "members")

    texts = docs.join(members.select("c").distinct(), docs.doc_id == F.col("c")).select("c", "text")
    texts = cut(texts.dropDuplicates(["c"]), "texts")
    stars = members.filter("c <> leader").select(F.col("leader").alias("a"), F.col("c").alias("b"), "n")
    links = _confirmed(stars, texts)
    roots = connected_components(links)
    sigs = cut(reps.select("c", "sig", "bands").join(members.select("c").distinct(), "c"), "signatures")
    of_band = members.select("band", "c")
    for find in (_second_stars, _remaining):
        links = links.union(_confirmed(find(of_band, roots, sigs), texts))
        roots = connected_components(links)

    named = classes.join(roots, classes.c == roots.node, "left").select("set_key", F.coalesce("root", "c").alias("root"))
    named = cut(parts.select("set_key", "part").join(named, "set_key"), "named")
    comp = live.join(named, ["set_key", "part"]).groupBy("doc_id").agg(F.min("root").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
