"""Batches of series of about one length, each padded to its own longest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import padded, validity
from .sampling import numbered


def by_length(lengths: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """``lengths`` with ``batch`` and ``longest``: ``size`` series a batch, the longest series first.

    Series are numbered over ranges of their length, so no task orders all of
    them; ties go by key.  Lengths inside a batch are neighbours in that order, so
    the batches together hold the least padding that batches of this size can.
    """
    order = lengths.withColumn("_shorter", -F.col(length))
    placed = numbered(order, ["_shorter", key], "_place").drop("_shorter")
    placed = placed.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")
    return placed.withColumn("longest", F.max(length).over(Window.partitionBy("batch")))  # ``size`` rows


def in_order(lengths: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """The same with series in the order of their keys, as a loader without regard to length deals them."""
    placed = numbered(lengths, [key], "_place").withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")
    return placed.withColumn("longest", F.max(length).over(Window.partitionBy("batch")))


def padded_patches(points: DataFrame, batches: DataFrame, key: str, width: int) -> DataFrame:
    """``(batch, key, patch, values, mask)``: each series of a batch up to the batch's longest, in patches.

    ``points`` are (key, pos, value) with pos from 0.  A patch has ``width`` steps,
    the last one of a batch maybe fewer; steps after a series' end are 0 and masked
    out.  No series is one row, however long.
    """
    steps = points.groupBy(key, F.floor(F.col("pos") / width).alias("patch")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_steps"))
    last = F.ceil(F.col("longest") / width) - 1
    all_ = batches.filter("longest > 0").select("batch", key, "longest", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("patch"))
    rows = all_.join(steps, [key, "patch"], "left")
    values = F.coalesce(F.transform("_steps", lambda x: x["value"]), F.array().cast("array<double>"))
    size = F.least(F.lit(width).cast("long"), F.col("longest") - F.col("patch") * width).cast("int")
    rows = rows.select("batch", key, "patch", values.alias("_v"), size.alias("_n"))
    return rows.select("batch", key, "patch", padded(F.col("_v"), F.col("_n")).alias("values"), validity(F.col("_v"), F.col("_n")).alias("mask"))
