"""Selection of the candidate with the least mean loss, and exact medians by distributed selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..scratch import written

#: Low bits of the 64-bit keys that each round leaves open: 22, 21 and 21 bits a round.
SHIFTS = (42, 21, 0)
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


@F.pandas_udf(LongType())
def ordered_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole numbers in the order of the given ones: equal for equal numbers, NaN (and null) the greatest."""
    for x in parts:
        bits = np.where(np.isnan(v := x.to_numpy(np.float64)), np.float64("nan"), v + 0.0).view(np.int64)
        yield pd.Series(bits ^ ((bits >> 63) & _LOW))


@F.pandas_udf(DoubleType())
def number_of_key(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The number of an ordered key."""
    for x in parts:
        key = x.to_numpy(np.int64)
        yield pd.Series((key ^ ((key >> 63) & _LOW)).view(np.float64))


def _group(by: str | None) -> Column:
    """The group as a text that is never null, to join on."""
    return F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))


def exact_medians(df: DataFrame, by: str | None, value: str) -> DataFrame:
    """``(by, median)`` of each group's values, exact, without a group's values in one place.

    The rank of each middle value is narrowed down in three rounds: a histogram
    over the next bits of order-preserving keys (at most 2 ** 22 buckets, far
    fewer in use) tells which bucket holds the rank, and only rows of such buckets
    stay.  After the last round a bucket is one number.  Nulls don't count; an
    even number of values has the mean of both middle ones; NaN is the greatest.
    A group without values has no row; without ``by`` all rows are one group.
    """
    names = [by] if by else []
    rows = df.filter(F.col(value).isNotNull()).select(*names, _group(by).alias("_k"), ordered_key(F.col(value).cast("double")).alias("_x"))
    rows = written(rows, "keys")
    groups = rows.groupBy(*names, "_k").agg(F.count("*").alias("_n"))
    middle = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    # A rank is counted in its bucket; before the first round all keys of a group are one.
    ranks = groups.select(*names, "_k", F.posexplode(middle).alias("_side", "_rank"), F.lit(0).cast("long").alias("_in"))
    live = rows.select("_k", "_x", F.lit(0).cast("long").alias("_in"))
    for shift in SHIFTS:
        tall = live.groupBy("_k", "_in", F.shiftright("_x", shift).alias("_to")).agg(F.count("*").alias("_c"))
        w = Window.partitionBy("_k", "_in").orderBy("_to")  # over buckets, not rows
        tall = tall.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
        at = ranks.join(tall, ["_k", "_in"]).filter("_rank >= _before and _rank < _before + _c")
        ranks = written(at.select(*names, "_k", "_side", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_to").alias("_in")), "ranks")
        if shift:
            open_ = ranks.select("_k", "_in").distinct()
            live = live.withColumn("_in", F.shiftright("_x", shift)).join(open_, ["_k", "_in"], "left_semi")
            live = written(live, "keys")
    return ranks.groupBy(*names, "_k").agg(F.avg(number_of_key(F.col("_in"))).alias("median")).select(*names, "median")


def loss_summary(predictions: DataFrame, candidate: str) -> DataFrame:
    """Rows, mean and exact median loss of each candidate; a missing loss is an error."""
    loss = F.coalesce(F.col("loss"), F.raise_error(F.lit("prediction without loss")).cast("double"))
    rows = predictions.select(candidate, loss.alias("_loss"))
    means = rows.groupBy(candidate).agg(F.count("*").alias("n"), F.avg("_loss").alias("mean_loss"))
    medians = exact_medians(rows, candidate, "_loss").select(F.col(candidate).alias("_c"), F.col("median").alias("median_loss"))
    return means.join(medians, F.col(candidate).eqNullSafe(F.col("_c"))).select(candidate, "n", "mean_loss", "median_loss")


def loss_by_type(predictions: DataFrame, candidate: str) -> DataFrame:
    return predictions.groupBy(candidate, "question_type").agg(F.avg("loss").alias("mean_loss"))


def best_candidate(summary: DataFrame, candidate: str, order: str | None = None) -> DataFrame:
    """The row of the least mean loss; the first in ``order`` (or by name) of equals."""
    best = F.min_by(F.struct(*summary.columns), F.struct("mean_loss", order or candidate))
    return summary.agg(best.alias("r")).filter("r is not null").select("r.*")


def key_agreement(predictions: DataFrame, candidate: str, keys: list[str]) -> DataFrame:
    """Keys that not every candidate has exactly once."""
    n = predictions.select(candidate).distinct().count()  # candidates are few
    per = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(candidate).alias("candidates"))
    return per.filter((F.col("n") != n) | (F.col("candidates") != n))


def totals(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Rows, total loss and average loss; without rows all are 0."""
    n, total = F.count("*"), F.coalesce(F.sum("loss"), F.lit(0.0))
    return predictions.groupBy(*by).agg(n.alias("n"), total.alias("total_loss"), (total / F.greatest(n, F.lit(1))).alias("average_loss"))
