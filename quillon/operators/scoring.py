"""Scores of predicted answers, and their report by question type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def not_nan(c: Column) -> Column:
    """Null in place of NaN, so that means leave it out."""
    return F.when(~F.isnan(c), c)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def score_predictions(predictions: DataFrame, rouge: bool = True) -> DataFrame:
    """One row of scores a prediction.

    Multiple choice and true/false compare what gold and prediction state: null
    if the gold states nothing, 0 if only the prediction doesn't.  All other
    types get token, ROUGE-L and numeric F1.  The expected text is
    ``expected_answer`` or ``answer``; the generated one ``generated_response``,
    ``prediction`` or ``response``, the first that isn't empty.  ``rouge=False``
    leaves out ROUGE-L and the primary score of open answers.
    """
    gold = T.first_filled(_column(predictions, "expected_answer"), _column(predictions, "answer"))
    made = T.first_filled(*(_column(predictions, c) for c in ("generated_response", "prediction", "response")))
    kind = F.coalesce(_column(predictions, "question_type"), F.lit("unknown"))
    df = predictions.withColumns({"_gold": gold, "_made": made, "question_type": kind, "loss": _column(predictions, "loss", "double")})
    choice, verdict = F.col("question_type") == "multiple_choice", F.col("question_type") == "true_false"
    open_ = ~choice & ~verdict
    g, m = F.col("_gold"), F.col("_made")
    # Tokens are cut once; those of closed questions are empty arrays.
    tokens = lambda c: F.when(open_, T.tokenize(c)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"_p": tokens(m), "_r": tokens(g)})
    if rouge:
        df = df.withColumn("_lcs", T.lcs_length(F.col("_p"), F.col("_r")))
    df = df.withColumns(
        {
            "gold_choice": F.when(choice, T.extract_choice(g)),
            "pred_choice": F.when(choice, T.extract_choice(m)),
            "gold_true_false": F.when(verdict, T.extract_true_false(g)),
            "pred_true_false": F.when(verdict, T.extract_true_false(m)),
            "token_f1": F.when(open_, T.pair_f1(F.col("_p"), F.col("_r"))),
            "numeric_f1": F.when(open_, T.numeric_f1(m, g)),
            "length_ratio": F.when(open_, F.size("_p") / F.greatest(F.size("_r"), F.lit(1))),
        }
    )
    same = lambda a, b: F.when(F.col(a).isNotNull(), F.col(a).eqNullSafe(F.col(b)).cast("double"))
    df = df.withColumns({"choice_correct": same("gold_choice", "pred_choice"), "true_false_correct": same("gold_true_false", "pred_true_false")})
    closed = F.coalesce("choice_correct", "true_false_correct")
    if rouge:
        df = df.withColumn("rouge_l_f1", F.when(open_, T.f1(F.col("_lcs"), F.size("_p"), F.size("_r"))))
        df = df.withColumn("primary_score", F.when(open_, 0.5 * F.col("token_f1") + 0.5 * F.col("rouge_l_f1")).otherwise(closed))
    else:
        df = df.withColumn("primary_score", closed)
    return df.drop("_gold", "_made", "_p", "_r", "_lcs")


def scored_report(scored: DataFrame) -> DataFrame:
    """Count, loss and mean scores of each question type, in long form.

    ``unparsed`` counts closed questions whose prediction states nothing.
    """
    parsed = F.when(F.col("question_type") == "multiple_choice", F.col("pred_choice").isNull()).when(
        F.col("question_type") == "true_false", F.col("pred_true_false").isNull()
    )
    metrics = [c for c in ("primary_score", "loss", "choice_correct", "true_false_correct", "token_f1", "rouge_l_f1", "numeric_f1") if c in scored.columns]
    return scored.groupBy("question_type").agg(
        F.count("*").alias("n"), *(F.avg(not_nan(F.col(c))).alias(c) for c in metrics),
        F.count_if(parsed).alias("unparsed"),
    )


def overall_report(scored: DataFrame) -> DataFrame:
    """One row: count, mean loss, and the mean of the types' mean primary scores."""
    kinds = scored.groupBy("question_type").agg(
        F.count("*").alias("n"), F.avg(not_nan(F.col("primary_score"))).alias("p"),
        F.sum(not_nan(F.col("loss"))).alias("l"), F.count(not_nan(F.col("loss"))).alias("k"),
    )
    return kinds.agg(F.sum("n").alias("n"), F.avg("p").alias("macro_primary_score"), (F.sum("l") / F.sum("k")).alias("loss"))
