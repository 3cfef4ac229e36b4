"""Score tables: rubric weights, complete records, means by mode, paired differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .latest import latest

# Dimensions of each question type and their weights.
RUBRIC = (
    ("multiple_choice", "correctness", 0.70),
    ("multiple_choice", "reasoning_quality", 0.30),
    ("open_ended", "relevance", 0.30),
    ("open_ended", "completeness", 0.35),
    ("open_ended", "accuracy", 0.35),
    ("true_false", "correctness", 0.60),
    ("true_false", "justification_quality", 0.40),
)
MODES = ("base", "wo_fixed_hint", "wo_local_hint", "wo_windows")
BASE = "base"


def rubric(spark: SparkSession) -> DataFrame:
    """``(question_type, dimension, weight)``: a fixed table of seven rows."""
    return spark.createDataFrame(list(RUBRIC), "question_type string, dimension string, weight double")


def record_finals(scores: DataFrame) -> DataFrame:
    """``(record_id, mode, question_type, final, dims)`` of complete records.

    The final is the sum of score times weight over the dimensions of the
    record's type; a record without all of them is left out, other dimensions
    are ignored.  Of repeated scores the last counts (by ``_line_no``, if there).
    """
    keys = ["record_id", "mode", "dimension"]
    scores = latest(scores, keys, "_line_no") if "_line_no" in scores.columns else scores
    need = rubric(scores.sparkSession).select("question_type", "dimension")
    need = need.withColumn("_need", F.count("*").over(_by_type()))
    rows = scores.filter(F.col("score").isNotNull()).join(F.broadcast(need), ["question_type", "dimension"])
    out = rows.groupBy("record_id", "mode", "question_type").agg(
        F.sum(F.col("score") * F.col("weight")).alias("final"), F.count("*").alias("_have"), F.max("_need").alias("_need"),
        F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("dims"),
    )
    return out.filter("_have = _need").drop("_have", "_need")


def _by_type():
    from pyspark.sql import Window

    return Window.partitionBy("question_type")


def weighted_table(scores: DataFrame) -> DataFrame:
    """``(mode, metric, value)``: means of finals and of each dimension, and the macro final."""
    finals = record_finals(scores)
    long = finals.select(
        "mode", "question_type",
        F.explode(F.map_concat("dims", F.create_map(F.lit("final"), F.col("final")))).alias("part", "value"),
    )
    means = long.groupBy("mode", "question_type", "part").agg(F.avg("value").alias("value"))
    table = means.select("mode", F.concat_ws("/", "question_type", "part").alias("metric"), "value")
    macro = means.filter("part = 'final'").groupBy("mode").agg(F.avg("value").alias("value"))
    return table.unionByName(macro.select("mode", F.lit("macro_final").alias("metric"), "value"))


def paired_differences(scores: DataFrame) -> DataFrame:
    """``(record_id, mode, diff)``: each other mode's final less that of the base mode."""
    finals = record_finals(scores).select("record_id", "mode", "final")
    base = finals.filter(F.col("mode") == BASE).select("record_id", F.col("final").alias("base"))
    other = finals.filter(F.col("mode") != BASE)
    return other.join(base, "record_id").select("record_id", "mode", (F.col("final") - F.col("base")).alias("diff"))
