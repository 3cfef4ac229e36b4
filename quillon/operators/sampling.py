"""Deterministic order, split, slices and shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from .generator import Falling

#: Draws of a block of the seeded shuffle.
BLOCK = 1 << 20
#: Share and seed of the split, and the slice of the short subset.
TRAIN_SHARE, SEED, SLICE_SHARE, SLICE_LENGTH = 0.95, 42, 0.02, 70


def permutation(spark: SparkSession, n: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``(position, source)``: where ``random.Random(seed).shuffle`` puts what of n things (fewer than 2 ** 32).

    The shuffle is a row of swaps: place i, from the last one down, with a drawn
    place j up to i.  The driver only runs through the generator, to learn where
    each block of draws begins; tasks draw the blocks.  Who stands at place p when
    its turn comes is who stood at i when the last swap before it, (i, p), came:
    the least such i above p.  These pointers are followed in doubling steps,
    so the order is resolved in rounds of joins, about log log n of them.
    """
    walk, starts = Falling(seed, n), []
    while walk.top > 1:
        starts.append((walk.top, walk.used))
        walk.draws(block)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, used in zip(batch.column("top").to_pylist(), batch.column("used").to_pylist(), strict=True):
                j = Falling(seed, top, used).draws(block)
                yield pa.RecordBatch.from_arrays([pa.array(top - 1 - np.arange(len(j), dtype=np.int64)), pa.array(j)], names=["i", "j"])

    blocks = spark.createDataFrame(starts, "top long, used long").repartition(max(1, len(starts)), "top")
    swaps = written(blocks.mapInArrow(draw, "i long, j long"), "swaps")
    up = written(swaps.filter("i <> j").groupBy("j").agg(F.min("i").alias("up")).withColumnRenamed("j", "p"), "pointers")
    while True:
        further = up.select(F.col("p").alias("q"), F.col("up").alias("to"))
        longer = up.join(further, up.up == further.q, "left")
        up = written(longer.select("p", F.coalesce("to", "up").alias("up"), F.col("to").isNotNull().alias("moved")), "pointers")
        if not up.filter("moved").limit(1).count():
            break
        up = up.drop("moved")
    # Step i takes who stands at j: brought there by the last swap of another place with j before it, if any.
    then = F.lead("i").over(Window.partitionBy("j").orderBy("i"))  # the swaps of one place are about log n
    steps = swaps.withColumn("then", then).select(
        F.col("i").alias("position"), F.when(F.col("i") == F.col("j"), F.col("i")).otherwise(F.col("then")).alias("p"), F.col("j").alias("own")
    )
    first = spark.range(min(n, 1)).select(F.col("id").alias("position"), F.col("id").alias("p"), F.col("id").alias("own"))  # place 0 has no swap of its own
    return steps.unionByName(first).join(up.select("p", "up"), "p", "left").select("position", F.coalesce("up", "p", "own").alias("source"))


def shuffled(names: DataFrame, name: str, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``(name, position)``: distinct names in the order of Python's seeded shuffle of their sorted list."""
    ranked = written(numbered(names.select(name), [name], "_rank"), "ranked")
    order = permutation(names.sparkSession, ranked.count(), seed, block)
    return ranked.join(order, F.col("_rank") == F.col("source")).select(name, "position")


def short_subset(names: DataFrame, name: str, seed: int = SEED, share: float = SLICE_SHARE, length: int = SLICE_LENGTH) -> DataFrame:
    """``(name, position)``: the slice of the shuffled names after the first share of them, numbered from 0."""
    order = written(shuffled(names, name, seed), "shuffled")
    start = int(order.count() * share)
    return order.filter((F.col("position") >= start) & (F.col("position") < start + length)).select(name, (F.col("position") - start).alias("position"))


def split_names(names: DataFrame, name: str, seed: int = SEED, share: float = TRAIN_SHARE) -> DataFrame:
    """``(name, position, split)``: the first share of the shuffled names is train, the rest val."""
    order = written(shuffled(names, name, seed), "shuffled")
    cut = int(order.count() * share)
    return order.withColumn("split", F.when(F.col("position") < cut, "train").otherwise("val"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based rank ``name`` of each row over the whole table.

    Rows are dealt by ranges of the order and written once; the ranges' counts (a
    row a range) tell where each one's numbers begin, so no task orders all rows.
    Equal keys are in one range.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    out = ranges.join(F.broadcast(starts), "_range")  # as many rows as shuffle partitions
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start")
    return out.withColumn(name, place.cast("long")).select(*df.columns, name)


def placed(df: DataFrame, by: list[str], order: list[str], weight: str, name: str, total: str) -> DataFrame:
    """``df`` with ``name``, the weights before each row in its group, and ``total``, the group's weight.

    Like :func:`numbered`, by ranges that are written once: a group of any size is
    many tasks' work.  Rows are unique in (by, order); the columns of ``by`` are
    not null.
    """
    ranges = written(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*by)
    per = ranges.groupBy(*by, "_range").agg(F.sum(weight).alias("_w"))  # a row a range and group in it
    before = F.sum("_w").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_w").over(group).alias(total))
    inside = F.sum(weight).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranges.join(starts, [*by, "_range"])
    return out.withColumn(name, (F.col("_before") + F.coalesce(inside, F.lit(0))).cast("long")).select(*df.columns, name, total)


def stride_shards(df: DataFrame, world: int, order: list[str]) -> DataFrame:
    """``df`` with ``rank``: rows dealt in turn, in order."""
    return numbered(df, order, "rank").withColumn("rank", F.pmod("rank", F.lit(world)))


def split(df: DataFrame, order: list[str], share: float = TRAIN_SHARE) -> DataFrame:
    """``df`` with ``split``: the first share of the rows in order is train, the rest val."""
    cut = int(df.count() * share)
    return numbered(df, order, "_place").withColumn("split", F.when(F.col("_place") < cut, "train").otherwise("val")).drop("_place")


def offset_limit(df: DataFrame, order: list[str], share: float = SLICE_SHARE, length: int = SLICE_LENGTH) -> DataFrame:
    """Rows from the given share on, ``length`` at most, in order."""
    return df.orderBy(*order).offset(int(df.count() * share)).limit(length)


def ordered_groups(df: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, first, position)``: groups in the order in which they first occur."""
    return numbered(df.groupBy(key).agg(F.min(order).alias("first")), ["first"], "position")
