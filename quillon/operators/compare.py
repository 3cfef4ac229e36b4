"""Comparison of two runs: paired scores, paired predictions, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import text_similarity
from ..scratch import written
from . import bootstrap
from .latest import latest
from .scoring import score_predictions
from .selection import exact_medians

PREDICTION = ["record_id", "mode"]
SCORE = ["record_id", "mode", "dimension"]


def score_pairs(left: DataFrame, right: DataFrame, left_predictions: DataFrame, right_predictions: DataFrame) -> DataFrame:
    """``(record_id, mode, dimension, left, right, delta, changed, same_prompt)``.

    ``changed`` tells whether the judged response differs.  Keys must be unique
    and the same on both sides (see ``latest.fail_on_duplicates`` and ``same_keys``).
    """
    hashes = "prompt_sha256" in left.columns and "prompt_sha256" in right.columns
    a = left.select(*SCORE, F.col("score").alias("left"), (F.col("prompt_sha256") if hashes else F.lit(None).cast("string")).alias("_lh"))
    b = right.select(*SCORE, F.col("score").alias("right"), (F.col("prompt_sha256") if hashes else F.lit(None).cast("string")).alias("_rh"))
    p = left_predictions.select(*PREDICTION, F.coalesce("response", F.lit("")).alias("_lp"))
    q = right_predictions.select(*PREDICTION, F.coalesce("response", F.lit("")).alias("_rp"))
    # A response is compared once, not once a dimension.
    changed = p.join(q, PREDICTION).select(*PREDICTION, (F.col("_lp") != F.col("_rp")).alias("changed"))
    out = a.join(b, SCORE).join(changed, PREDICTION)
    return out.select(*SCORE, "left", "right", (F.col("right") - F.col("left")).alias("delta"), "changed", F.col("_lh").eqNullSafe(F.col("_rh")).alias("same_prompt"))


def summarize_scores(pairs: DataFrame) -> DataFrame:
    """Means of both sides, of the difference and its size, by bucket.

    Buckets: overall, changed, unchanged, and each dimension; all from one pass.
    """
    return (
        in_buckets(pairs).groupBy("bucket")
        .agg(
            F.count("*").alias("n"), F.avg("left").alias("left_mean"), F.avg("right").alias("right_mean"), F.avg("delta").alias("delta_mean"),
            F.avg(F.abs("delta")).alias("mean_absolute_delta"), F.count_if(F.col("left") == F.col("right")).alias("exact"),
            F.count_if(~F.col("changed") & F.col("same_prompt")).alias("unchanged_same_prompt"),
        )
    )


def in_buckets(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``bucket``: a row for each bucket that a pair is in."""
    buckets = F.array(F.lit("overall"), F.when(F.col("changed"), "changed").otherwise("unchanged"), F.concat(F.lit("dimension/"), "dimension"))
    return pairs.withColumn("bucket", F.explode(buckets))


def bucket_seeds(pairs: DataFrame, seed: int) -> dict[str, int]:
    """Seeds of the buckets: of three fixed ones, then of the dimensions in order (a few names)."""
    dimensions = sorted(r[0] for r in pairs.select("dimension").distinct().collect())
    return {"overall": seed, "changed": seed + 1, "unchanged": seed + 2} | {f"dimension/{d}": seed + 10 + i for i, d in enumerate(dimensions)}


def delta_intervals(pairs: DataFrame, samples: int = 5000, seed: int = 72, exact: bool = False, draws: str = "split") -> DataFrame:
    """``(bucket, n, mean, low, high)``: the mean difference of each bucket and its interval.

    Bounds are the means at 2.5 and 97.5 percent of samples - 1.  ``draws`` are
    ``split`` (counts from a splitting tree, for data of any size), ``exact`` (of
    Python's generator, with a seed of its own for each bucket; ``exact=True``
    says the same) or ``hashed`` (hashes of bucket, round and place, which SQL can
    repeat).
    """
    draws = "exact" if exact else draws
    if draws in ("exact", "hashed"):  # read several times: for seeds, for ranges and for rows
        pairs = written(pairs.select(*SCORE, "delta", "changed"), "pairs")
    rows = in_buckets(pairs).select("bucket", "delta", *SCORE)
    if draws == "split":
        return bootstrap.split_intervals(rows, "bucket", "delta", samples, seed, closed=True)
    if draws == "exact":
        return bootstrap.exact_intervals(rows, "bucket", "delta", SCORE, samples, seed, closed=True, seeds=bucket_seeds(pairs, seed))
    if draws == "hashed":
        return bootstrap.hashed_intervals(rows, "bucket", "delta", SCORE, samples, seed, closed=True)
    raise ValueError(f"unknown draws: {draws}")


def type_mismatches(pairs: DataFrame) -> DataFrame:
    """``(record_id, mode, left, right)``: pairs of predictions whose question types differ; a missing one is ``unknown``."""
    kind = lambda s: F.coalesce(f"{s}_question_type", F.lit("unknown"))
    return pairs.select(*PREDICTION, kind("left").alias("left"), kind("right").alias("right")).filter("left <> right")


def same_types(pairs: DataFrame) -> DataFrame:
    """``pairs`` of predictions, after a check that both sides have the same question type."""
    found = type_mismatches(pairs).orderBy(*PREDICTION).limit(1).collect()
    if found:
        raise ValueError(f"question type mismatch for {tuple(found[0])[:2]!r}")
    return pairs


def prediction_pairs(left: DataFrame, right: DataFrame, similarity: bool = False) -> DataFrame:
    """Predictions of two runs side by side, by key."""
    cols = lambda df, s: df.select(*PREDICTION, *(F.col(c).alias(f"{s}_{c}") for c in ("question_type", "response", "primary_score")))
    scored = [score_predictions(x, rouge=similarity) for x in (left, right)]
    out = cols(scored[0], "left").join(cols(scored[1], "right"), PREDICTION)
    out = out.withColumn("same", F.coalesce("left_response", F.lit("")) == F.coalesce("right_response", F.lit("")))
    return out.withColumn("similarity", text_similarity("left_response", "right_response")) if similarity else out


def summarize_predictions(pairs: DataFrame) -> DataFrame:
    """Equal and changed responses, mean lengths and mean primary scores by question type.

    A missing primary score is left out on its side only.
    """
    like = [F.avg("similarity").alias("mean_similarity")] if "similarity" in pairs.columns else []
    if like:  # read twice: for means and for the median
        pairs = written(pairs, "pairs")
    out = pairs.groupBy(F.col("left_question_type").alias("question_type")).agg(
        F.count("*").alias("n"), F.count_if("same").alias("exact"), F.count_if(~F.col("same")).alias("changed"),
        F.avg(F.length("left_response")).alias("left_length"), F.avg(F.length("right_response")).alias("right_length"),
        F.avg("left_primary_score").alias("left_score"), F.avg("right_primary_score").alias("right_score"),
        (F.avg("right_primary_score") - F.avg("left_primary_score")).alias("score_delta"), *like,
    )
    if not like:
        return out
    medians = exact_medians(pairs, "left_question_type", "similarity").select("left_question_type", F.col("median").alias("median_similarity"))
    return out.join(medians, F.col("question_type").eqNullSafe(F.col("left_question_type")), "left").drop("left_question_type")


def overlap_fraction(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: shared keys, equal responses among them, and their share (null if none)."""
    if "_line_no" in left.columns:
        left = latest(left, PREDICTION, "_line_no")
    if "_line_no" in right.columns:
        right = latest(right, PREDICTION, "_line_no")
    both = left.select(*PREDICTION, F.col("response").alias("_l")).join(right.select(*PREDICTION, F.col("response").alias("_r")), PREDICTION)
    n, same = F.count("*"), F.count_if(F.col("_l").eqNullSafe(F.col("_r")))
    return both.agg(n.alias("shared"), same.alias("exact"), (same / F.nullif(n, F.lit(0))).alias("fraction"))
