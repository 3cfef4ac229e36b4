"""Audits: every check as a row (check, bad, ok), and a wrapper that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logprobs import valid_distribution
from .latest import duplicate_keys
from .reconcile import exact_difference
from .tables import MODES, rubric

#: Name of the sampling method, and the samples that it must have.
SAMPLED, SAMPLES = r"\Aexact_sample_mean_(\d+)\z", 20


def _rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Counts of all checks over ``df`` in one pass, in long form."""
    counted = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("bad")) for n in checks))
    return counted.select(F.explode(pairs).alias("x")).select("x.check", "x.bad")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")


def empty_response(c: Column) -> Column:
    """Only white space; a null response isn't empty."""
    return F.regexp_replace(c, r"(?U)\s+", "") == ""


def expected_predictions(predictions: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Every record in every mode."""
    ids = predictions.select("record_id").distinct()
    return ids.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))


def expected_scores(predictions: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Every expected prediction with the dimensions of its question type."""
    kinds = predictions.select("record_id", "mode", "question_type").distinct()
    dims = F.broadcast(rubric(predictions.sparkSession).select("question_type", "dimension"))
    return expected_predictions(predictions, modes).join(kinds, ["record_id", "mode"]).join(dims, "question_type").select("record_id", "mode", "dimension")


def audit_predictions(predictions: DataFrame, manifest: DataFrame | None = None, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Checks of a prediction table: duplicate keys, empty responses, missing and unexpected keys."""
    keys = ["record_id", "mode"]
    diff = exact_difference(predictions, expected_predictions(predictions, modes), keys)
    out = (
        _count(duplicate_keys(predictions, keys), "duplicate_keys")
        .union(_rows(predictions, {"empty_response": empty_response(F.col("response"))}))
        .union(_rows(diff, {"unexpected": F.col("side") == "left", "missing": F.col("side") == "right"}))
    )
    if manifest is not None:
        out = out.union(_count(exact_difference(predictions, manifest, ["record_id"]), "record_ids"))
    return out.withColumn("ok", F.col("bad") == 0)


def score_checks(most_missing: float | None = None, need_logprobs: bool = False, need_hashes: bool = False) -> dict[str, Column]:
    """Row checks of a score table, by name; true where a row is bad."""
    score = F.col("score").try_cast("double")
    samples = F.nullif(F.regexp_extract("method", SAMPLED, 1), F.lit("")).cast("int")
    checks = {
        "score_not_numeric": score.isNull(),
        "score_out_of_range": F.isnan(score) | ~score.between(1.0, 5.0),
        "samples": samples.isNotNull() & ((samples != SAMPLES) | (F.coalesce(F.size("fallback_scores"), F.lit(0)) != SAMPLES)),
    }
    if need_logprobs:
        checks["logprobs"] = ~F.coalesce(F.col("logprobs_returned"), F.lit(False)) | F.col("distribution").isNull() | ~valid_distribution(F.col("distribution"))
    if most_missing is not None:
        bound = F.col("missing_score_mass_upper_bound")
        checks["missing_mass"] = bound.isNull() | F.isnan(bound) | (bound < 0) | (bound > most_missing)
    if need_hashes:
        checks["prompt_hash"] = ~F.coalesce(F.col("prompt_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))
    return checks


def audit_scores(scores: DataFrame, predictions: DataFrame, modes: tuple[str, ...] = MODES, allowed_methods: tuple[str, ...] = (), expected: dict[str, str] | None = None, **options) -> DataFrame:
    """Checks of a score table against its predictions; all row checks in one pass.

    ``expected`` names columns whose only value must be the given one.
    """
    keys = ["record_id", "mode", "dimension"]
    diff = exact_difference(scores, expected_scores(predictions, modes), keys)
    checks = score_checks(**options)
    if allowed_methods:
        checks["method"] = ~F.coalesce(F.col("method"), F.lit("")).isin(*allowed_methods)
    for name, value in (expected or {}).items():
        checks[name] = ~F.coalesce(F.col(name).cast("string") == value, F.lit(False))
    out = (
        _count(duplicate_keys(scores, keys), "duplicate_keys")
        .union(_rows(scores, checks))
        .union(_rows(diff, {"unexpected": F.col("side") == "left", "missing": F.col("side") == "right"}))
    )
    return out.withColumn("ok", F.col("bad") == 0)


def first_bad_row(scores: DataFrame, order: str = "_line_no", **options) -> DataFrame:
    """The first bad row in file order and the first check that it fails."""
    checks = score_checks(**options)
    failed = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))
    bad = scores.withColumn("check", failed).filter("check is not null")
    return bad.agg(F.min_by(F.struct("record_id", "mode", "dimension", "check"), order).alias("r")).filter("r is not null").select("r.*")


def audit_validation(predictions: DataFrame, expected_series: DataFrame, per_series: int = 2) -> DataFrame:
    """Checks of validation rows: base mode only, exact series, so many records each."""
    counts = predictions.groupBy("series_file").agg(F.count("*").alias("n"))
    out = (
        _count(duplicate_keys(predictions, ["record_id", "mode"]), "duplicate_keys")
        .union(_rows(predictions, {"other_modes": F.col("mode") != "base", "empty_response": empty_response(F.col("response"))}))
        .union(_count(exact_difference(counts, expected_series, ["series_file"]), "series"))
        .union(_rows(counts, {"records_of_series": F.col("n") != per_series}))
    )
    return out.withColumn("ok", F.col("bad") == 0)


def fail_closed(report: DataFrame) -> DataFrame:
    """The report itself if all checks hold; else an error that names the others."""
    bad = report.filter("not ok").collect()  # a row a check
    if bad:
        raise ValueError("audit failed: " + ", ".join(f"{r['check']} ({r['bad']})" for r in sorted(bad)))
    return report


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows by value of a column; null counts as the empty text."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
