"""Bootstrap confidence intervals of a mean.

Three ways to draw.  ``split_intervals`` is the one for large data: a resample is
the multinomial count of each value, taken from a tree that splits the draws, and
only sums of rounds are shuffled.  ``exact_intervals`` has the draws of Python's
seeded generator, in its order.  ``hashed_intervals`` draws by MD5, which SQL can
repeat.  The last two make every draw and send it in packed form (see ``draws``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from . import draws as D
from .generator import accepted, good, resumed, stream
from .sampling import numbered, placed

#: Rounds in a row of sums, words of the generator in a block, and words that are made at a time.
SLICE, BLOCK, STEP = 500, 1 << 21, 1 << 20


def interval_indices(samples: int, alpha: float = 0.05, closed: bool = False) -> tuple[int, int]:
    """Places of both bounds among the sorted means; ``closed`` counts from samples - 1."""
    top = samples - 1 if closed else samples
    return max(0, int(alpha / 2 * top)), min(samples - 1, int((1 - alpha / 2) * top))


def _tasks(df: DataFrame) -> int:
    """Tasks that long work on few rows is dealt to; a stated number keeps small partitions from being merged."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _clean(df: DataFrame, group: str, value: str, *more: str) -> DataFrame:
    """Rows with a value, as ``_v``; the group also as a text that is never null, ``_k``."""
    v = F.col(value).cast("double")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))
    return df.filter(v.isNotNull() & ~F.isnan(v)).select(F.col(group), key.alias("_k"), (v + 0.0).alias("_v"), *more)


def _bounds(of: DataFrame, means: DataFrame, group: str, samples: int, closed: bool) -> DataFrame:
    """``(group, n, mean, low, high)`` from ``of`` (group, _k, n, mean) and the rounds' means (_k, _m)."""
    if samples <= 0:
        return of.select(group, "n", "mean", F.col("mean").alias("low"), F.col("mean").alias("high"))
    low, high = interval_indices(samples, closed=closed)
    bounds = means.groupBy("_k").agg(F.array_sort(F.collect_list("_m")).alias("_s"))  # ``samples`` numbers a group
    bounds = bounds.select("_k", F.get("_s", F.lit(low)).alias("low"), F.get("_s", F.lit(high)).alias("high"))
    return of.join(bounds, "_k").select(group, "n", "mean", "low", "high")


class Splits:
    """Draws of a resample below each place, for all rounds at once.

    ``n`` draws fall on the places 0..n-1.  A node is a range whose size is a
    power of two (cut at n); how many of its draws fall on its left half is a
    binomial number from a generator that the seed, the group and the node name.
    So any task can tell the draws on any range of places, and all tasks agree.
    """

    def __init__(self, seed: int, key: str, n: int, rounds: int):
        self._name, self.n, self.rounds = f"{seed}|{n}|{key}|", n, rounds
        self._path = [(0, 1 << max(n - 1, 0).bit_length(), np.full(rounds, n, np.int64), np.zeros(rounds, np.int64))]

    def _left(self, a: int, size: int, draws: np.ndarray) -> np.ndarray:
        end, mid = min(a + size, self.n), a + size // 2
        if mid >= end:
            return draws
        key = int.from_bytes(hashlib.blake2b(f"{self._name}{a}|{size}".encode(), digest_size=16).digest(), "little")
        return np.random.Generator(np.random.Philox(key=key)).binomial(draws, (mid - a) / (end - a))

    def below(self, x: int) -> np.ndarray:
        """Draws on places below ``x``, a number a round; best asked in ascending order."""
        path = self._path
        while len(path) > 1 and not path[-1][0] < x < path[-1][0] + path[-1][1]:
            path.pop()  # what is kept are the nodes that hold x inside
        while True:
            a, size, draws, before = path[-1]
            if x <= a:
                return before
            if x >= min(a + size, self.n):
                return before + draws
            left, half = self._left(a, size, draws), size // 2
            path.append((a, half, left, before) if x <= a + half else (a + half, half, draws - left, before + left))


_SUMS = "_k string, _slice int, _sums array<double>"


def _weighted(seed: int, rounds: int):
    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over a task's values of value times weight, round by round, for each group."""
        sums: dict[str, np.ndarray] = {}
        splits: dict[str, Splits] = {}
        for batch in batches:
            for key, value, m, start, n in zip(*(batch.column(c).to_pylist() for c in ("_k", "_v", "_m", "_start", "_n")), strict=True):
                if key not in sums:
                    sums[key], splits[key] = np.zeros(rounds), Splits(seed, key, n, rounds)
                s = splits[key]
                low = s.below(start)
                sums[key] += value * (s.below(start + m) - low)
        for key, total in sums.items():
            parts = [total[k : k + SLICE] for k in range(0, rounds, SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["_k", "_slice", "_sums"]
            )

    return weighted


def split_intervals(df: DataFrame, group: str, value: str, samples: int = 10_000, seed: int = 72, closed: bool = False) -> DataFrame:
    """``(group, n, mean, low, high)``: independent resamples without copies of the values.

    Equal values are one row with their number; it takes as many of a group's
    places, in the order of values.  Each round is a weight of that row: the draws
    on its places.  Tasks send sums of weighted values, ``samples`` numbers for
    each group that they hold, whatever the rows.  The same data give the same
    draws, whatever the partitions.  Null and NaN values don't count; a group
    without values has no row, and one with a single value has it as both bounds.
    """
    tally = _clean(df, group, value).groupBy(group, "_k", "_v").agg(F.count("*").alias("_m"))
    places = written(placed(tally, ["_k"], ["_v"], "_m", "_start", "_n"), "places")
    of = places.groupBy(group, "_k").agg(F.max("_n").alias("n"), (F.sum(F.col("_v") * F.col("_m")) / F.max("_n")).alias("mean"))
    if samples <= 0:
        return _bounds(of, of, group, samples, closed)
    dealt = places.select("_k", "_v", "_m", "_start", "_n").repartitionByRange(_tasks(df), "_k", "_start")
    sums = dealt.sortWithinPartitions("_k", "_start").mapInArrow(_weighted(seed, samples), _SUMS)
    rounds = sums.select("_k", "_slice", F.posexplode("_sums").alias("_i", "_x")).groupBy("_k", "_slice", "_i").agg(F.sum("_x").alias("_x"))
    means = rounds.join(of.select("_k", "n"), "_k").select("_k", (F.col("_x") / F.col("n")).alias("_m"))
    return _bounds(of, means, group, samples, closed)


_BLOCK = "_k string, n long, _need long, _block long, _key binary, _pos int"


def _walk(size: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The generator's state where each block of a group's stream begins."""
        for batch in batches:
            for r in batch.to_pylist():
                words = stream(r["_seed"])
                for k in range(r["_blocks"]):
                    state = words.state["state"]
                    yield pa.RecordBatch.from_pylist([{"_k": r["_k"], "n": r["n"], "_need": r["_need"], "_block": k, "_key": state["key"].tobytes(), "_pos": state["pos"]}], schema=_BLOCK_ARROW)
                    words.random_raw(size, output=False)

    return walk


_BLOCK_ARROW = pa.schema([("_k", pa.string()), ("n", pa.int64()), ("_need", pa.int64()), ("_block", pa.int64()), ("_key", pa.binary()), ("_pos", pa.int32())])


def _count(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the number of their accepted draws."""
        for batch in batches:
            got = [sum(good(words, r["n"]) for words in _words(r, size)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=[*batch.schema.names, "_got"])

    return count


def _words(r: dict, size: int | None = None) -> Iterator[np.ndarray]:
    """The generator's words from a block's beginning, to its end or on and on."""
    words, left = resumed(r["_key"], r["_pos"]), size
    while left is None or left > 0:
        now = STEP if left is None else min(left, STEP)
        yield words.random_raw(now)
        left = left if left is None else left - now


def _rounds(rows: Iterator[pa.RecordBatch], most: int = D.CHUNK) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """``(_k, n, round, places)`` of the rounds that begin in blocks, whole up to ``most`` places, beyond that in pieces.

    A block's last round is followed into the blocks after it, which leave it out:
    places of a round that are sent together take less room.
    """
    for batch in rows:
        for r in batch.to_pylist():
            n, b, end = r["n"], r["_first"], r["_end"]
            skip, words, got = b * n - r["_before"], _words(r), np.empty(0, np.uint32)
            while b < end:
                piece, at, left = np.empty(min(n, most), np.uint32), 0, n
                while left:
                    if skip >= len(got):
                        skip -= len(got)
                        got = accepted(next(words), n)
                        continue
                    take = min(len(got) - skip, left, len(piece) - at)
                    piece[at : at + take] = got[skip : skip + take]
                    skip, at, left = skip + take, at + take, left - take
                    if not left or at == len(piece):
                        yield r["_k"], n, b, piece[:at]
                        at = 0
                b += 1


def _blocks(of: DataFrame, samples: int, seed: int, seeds: dict[str, int] | None, block: int) -> DataFrame:
    """Blocks of the groups' streams with their state and the number of draws before each.

    A group's stream is walked through once, by one task that keeps nothing of it
    (some 5 ns a word); a block's words are then made twice, by whatever task:
    first to count its accepted draws, and, when the sums of the blocks before
    tell the number of its first draw, to send the rounds that begin in it.
    """
    need = F.col("n") * samples
    # A try is accepted with a chance of n / 2 ** bits; two blocks and 2 % more than expected are ample.
    tries = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) * samples
    blocks = F.ceil(tries * 1.02 / block).cast("long") + 2
    own = F.lit(seed)
    for name, other in (seeds or {}).items():
        own = F.when(F.col("_k") == f"={name}", other).otherwise(own)
    of = of.select("_k", "n", need.cast("long").alias("_need"), own.cast("long").alias("_seed"), blocks.alias("_blocks"))
    rows = of.repartition(_tasks(of), "_k").mapInArrow(_walk(block), _BLOCK).repartition(_tasks(of), "_k", "_block")
    rows = written(rows.mapInArrow(_count(block), f"{_BLOCK}, _got long"), "blocks")
    # A row a block: their sums are cheap, whatever the draws.
    from pyspark.sql import Window

    w = Window.partitionBy("_k").orderBy("_block")
    before = F.coalesce(F.sum("_got").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_before": before, "_all": F.sum("_got").over(Window.partitionBy("_k"))})
    enough = F.when(F.col("_all") >= F.col("_need"), F.col("_need")).otherwise(F.raise_error(F.lit("too few draws in the blocks of the generator")).cast("long"))
    rows = rows.withColumn("_need", enough).withColumns({"_first": F.expr("(_before + n - 1) div n"), "_end": F.expr("(least(_before + _got, _need) + n - 1) div n")})
    return rows.filter("_first < _end").drop("_all", "_got", "_need").repartition(_tasks(of), "_k", "_block")


def generator_draws(of: DataFrame, samples: int, seed: int, seeds: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """``(_k, _b, _i)``: places that Python's generator draws for each round, for groups ``of`` (_k, n)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, b, places in _rounds(batches):
            for a in range(0, len(places), 1 << 16):
                i = places[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(i), pa.string()), pa.array(np.full(len(i), b)), pa.array(i, pa.int64())], names=["_k", "_b", "_i"])

    return _blocks(of, samples, seed, seeds, block).mapInArrow(draw, "_k string, _b long, _i long")


def packed_generator_draws(of: DataFrame, samples: int, seed: int, seeds: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The same draws in packed form."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from D.batches((k, b, *row) for k, n, b, places in _rounds(batches) for row in D.packed(places, n))

    return _blocks(of, samples, seed, seeds, block).mapInArrow(draw, D.PACKED)


def _numbered(df: DataFrame, group: str, value: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups (group, _k, n, mean) and their values (_k, _i, _v), numbered in order."""
    more = [c for c in order if c != group]
    v = numbered(_clean(df, group, value, *more), ["_k", *more], "_g")
    of = written(v.groupBy(group, "_k").agg(F.count("*").alias("n"), F.min("_g").alias("_first"), F.avg("_v").alias("mean")), "groups")
    return of, v.join(of.select("_k", "_first"), "_k").select("_k", (F.col("_g") - F.col("_first")).alias("_i"), "_v")


def _means(of: DataFrame, draws: DataFrame, values: DataFrame) -> DataFrame:
    sums = D.sums_of_rounds(draws, values, _tasks(of))
    return sums.join(of.select("_k", "n"), "_k").select("_k", (F.col("_x") / F.col("n")).alias("_m"))


def exact_intervals(
    df: DataFrame, group: str, value: str, order: list[str], samples: int = 1000, seed: int = 72, closed: bool = False, seeds: dict[str, int] | None = None, block: int = BLOCK
) -> DataFrame:
    """``(group, n, mean, low, high)`` with the draws of ``random.Random(seed)`` in their order.

    Round by round, n draws below n index the group's values in ``order``.  The
    draws of a group are made in blocks by many tasks and sent in packed form to
    the parts of its values, so neither is one task's work.  ``seeds`` names a
    seed for each group (by its text).  At most 2 ** 32 - 1 values a group.
    """
    of, values = _numbered(df, group, value, order)
    if samples <= 0:
        return _bounds(of, of, group, samples, closed)
    return _bounds(of, _means(of, packed_generator_draws(of, samples, seed, seeds, block), values), group, samples, closed)


def hashed_draw(group: Column, round_: Column, position: Column, n: Column, seed: int) -> Column:
    """A place in 0..n-1 for each group, round and position, by 60 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), group.cast("string"), round_.cast("string"), position.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n


def _hash(seed: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed draws of rounds (_k, n, _b) at the positions from _from on."""

        def rows() -> Iterator[tuple[str, int, int, bool, bytes]]:
            for batch in batches:
                for r in batch.to_pylist():
                    name = r["_k"][1:] if r["_k"].startswith("=") else None
                    places = D.hashed_places(seed, name, r["_b"], r["_from"], min(r["n"], r["_from"] + D.CHUNK), r["n"])
                    for row in D.packed(places, r["n"]):
                        yield r["_k"], r["_b"], *row

        return D.batches(rows())

    return draw


def hashed_intervals(df: DataFrame, group: str, value: str, order: list[str], samples: int = 1000, seed: int = 72, closed: bool = False) -> DataFrame:
    """``(group, n, mean, low, high)`` by independent draws: those of :func:`hashed_draw`.

    Values are numbered over the table, group by group, without ordering a group
    in one task.  Tasks make the hashes of a round's positions and send the places
    in packed form to the parts of the values.
    """
    of, values = _numbered(df, group, value, order)
    if samples <= 0:
        return _bounds(of, of, group, samples, closed)
    whole = lambda stop, step=1: F.sequence(F.lit(0).cast("long"), stop.cast("long") - 1, F.lit(step).cast("long"))
    rounds = of.select("_k", "n", F.explode(whole(F.lit(samples))).alias("_b")).select("_k", "n", "_b", F.explode(whole(F.col("n"), D.CHUNK)).alias("_from"))
    draws = rounds.repartition(_tasks(df), "_k", "_b", "_from").mapInArrow(_hash(seed), D.PACKED)
    return _bounds(of, _means(of, draws, values), group, samples, closed)
