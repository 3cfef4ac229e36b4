"""The engine's tables, derived from the driver's tables.

Predictions, scores and losses aren't among the test tables, so they are made
of ``conversations``, ``embeddings`` and ``events`` by expressions that both
Spark and DuckDB read; the expressions are shared, the plans aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import MODES, RUBRIC, rubric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPE = "CASE CAST((conv_id + turn) % 3 AS INT) WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'true_false' ELSE 'open_ended' END"
_LETTER = "substring('ABCD', CAST(conv_id % 4 AS INT) + 1, 1)"
_GUESS = "substring('ABCD', CAST((conv_id + turn) % 4 AS INT) + 1, 1)"
_ANSWER = f"""CASE question_type WHEN 'multiple_choice' THEN {_LETTER} || ') ' || reply
    WHEN 'true_false' THEN (CASE WHEN conv_id % 2 = 0 THEN 'True. ' ELSE 'False. ' END) || reply ELSE reply END"""
_RESPONSE = f"""CASE question_type
    WHEN 'multiple_choice' THEN (CASE mode WHEN 'base' THEN 'The correct answer is ' || {_LETTER} WHEN 'wo_fixed_hint' THEN {_GUESS} || '. ' || question
        WHEN 'wo_local_hint' THEN question ELSE 'Option ' || {_GUESS} || ', as ' || question END)
    WHEN 'true_false' THEN (CASE mode WHEN 'base' THEN (CASE WHEN conv_id % 2 = 0 THEN 'The statement is true.' ELSE 'The statement is FALSE.' END)
        WHEN 'wo_fixed_hint' THEN 'Yes, ' || question WHEN 'wo_local_hint' THEN question ELSE 'No. ' || reply END)
    ELSE (CASE mode WHEN 'base' THEN reply WHEN 'wo_fixed_hint' THEN question WHEN 'wo_local_hint' THEN reply || ' 12 ' || question
        ELSE question || ' 3.5 of 12 ' || reply END) END"""
_LOSS = "CAST((7 * conv_id + 3 * turn + 5 * mi) % 97 AS DOUBLE) / 8"
_SERIES = "'series_' || lpad(CAST(conv_id AS STRING), 6, '0') || '.json'"
#: Every eleventh (by a mixed number) score is missing, so that incomplete records occur.
_SCORE = "CASE WHEN (11 * conv_id + 5 * turn + 3 * mi + di) % 11 = 0 THEN NULL ELSE CAST(1 + (7 * conv_id + 3 * turn + mi + 5 * di) % 5 AS DOUBLE) END"


def sql(expression: str) -> str:
    """A shared expression as DuckDB writes it."""
    return expression.replace("STRING", "VARCHAR")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that the next turn answers: conv_id, turn, record_id, question, reply.

    The window's one shuffle has as many partitions as the session says: what
    follows works long on few bytes, so merging small partitions would make it slow.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    dealt = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    turns = dealt.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("text").over(w)})
    return turns.filter("role = 'user' and next_role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("conv_"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(":"), F.col("turn").cast("string")).alias("record_id"),
        F.col("text").alias("question"), "reply",
    )


QA_SQL = """qa AS (
  SELECT conv_id, turn, 'conv_' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || ':' || CAST(turn AS VARCHAR) AS record_id, text AS question, reply
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question in four modes: record_id, mode, question_type, question, answer, response, loss, series_file."""
    df = qa(spark, sf_dir).withColumn("question_type", F.expr(_TYPE))
    df = df.select("*", F.posexplode(F.array(*map(F.lit, MODES))).alias("mi", "mode"))
    return df.select(
        "conv_id", "turn", "mi", "record_id", "mode", "question_type", "question",
        F.expr(_ANSWER).alias("answer"), F.expr(_RESPONSE).alias("response"), F.expr(_LOSS).alias("loss"), F.expr(_SERIES).alias("series_file"),
    )


_MODES_SQL = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MODES))
PREDICTIONS_SQL = f"""{QA_SQL}, predictions AS (
  SELECT conv_id, turn, mi, record_id, mode, question_type, question, {_ANSWER} AS answer, {_RESPONSE} AS response, {_LOSS} AS loss, {sql(_SERIES)} AS series_file
  FROM (SELECT *, {_TYPE} AS question_type FROM qa), (VALUES {_MODES_SQL}) AS m(mi, mode))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction's score in each dimension, some missing, with the fields of audits."""
    dims = rubric(spark).withColumn("di", F.expr(_DIM_INDEX))
    rows = predictions(spark, sf_dir).join(F.broadcast(dims), "question_type")
    return rows.select(
        "conv_id", "turn", "mi", "di", "record_id", "mode", "dimension", "question_type", "weight", F.expr(_SCORE).alias("score"),
        F.expr(_METHOD).alias("method"), F.expr(_BOUND).alias("missing_score_mass_upper_bound"), F.sha2(F.concat_ws("|", "question", "answer", "response", "dimension"), 256).alias("prompt_sha256"),
    )


_DIM_INDEX = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(dict.fromkeys(d for _, d, _ in RUBRIC))) + " END"
_METHOD = "CASE CAST((conv_id + di) % 4 AS INT) WHEN 0 THEN 'exact_sample_mean_20' WHEN 1 THEN 'exact_sample_mean_5' ELSE 'final_score_top_logprobs' END"
_BOUND = "CAST((conv_id + turn + mi + di) % 20 AS DOUBLE) / 1.0e7"
_RUBRIC_SQL = ", ".join(f"('{q}', '{d}', CAST({w} AS DOUBLE))" for q, d, w in RUBRIC)
SCORES_SQL = f"""{PREDICTIONS_SQL}, rubric AS (
  SELECT *, {_DIM_INDEX} AS di FROM (VALUES {_RUBRIC_SQL}) AS r(question_type, dimension, weight)
), scores AS (
  SELECT conv_id, turn, mi, di, record_id, mode, dimension, p.question_type, weight, {_SCORE} AS score, {_METHOD} AS method, {_BOUND} AS missing_score_mass_upper_bound,
    sha256(concat_ws('|', question, answer, response, dimension)) AS prompt_sha256
  FROM predictions p JOIN rubric USING (question_type))"""


def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as series: series (user_id), pos from 0, value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), (F.row_number().over(w) - 1).alias("pos"), "value", "event_type", "event_id")


POINTS_SQL = """points AS (
  SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, event_type, event_id FROM events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole series: series, n, values (array, in order)."""
    points = series_points(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return points.select("series", F.size("p").alias("n"), F.transform("p", lambda x: x["value"]).alias("values"))


SERIES_SQL = f"{POINTS_SQL}, series AS (SELECT series, count(*) AS n, list(value ORDER BY pos) AS vals FROM points GROUP BY series)"


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded judge responses: vec_id, content, tokens (with logprobs from the embedding).

    The tokens spell ``Thoughts on 5 and 2. **Score:** d`` where d follows from the
    label; the score token's alternatives are the five digits, whose logprobs are
    the first five components, and a last one lower by 30 for some rows.
    """
    alts = "transform(sequence(1, 5), i -> struct(CAST(i AS STRING) AS token, CAST(embedding[i - 1] AS DOUBLE) AS logprob))"
    none = "CAST(array() AS array<struct<token:string,logprob:double>>)"
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.expr("CAST(label % 5 + 1 AS STRING)").alias("digit"), F.expr(alts).alias("alts"),
    ).select(
        "vec_id", F.concat(F.lit("Thoughts on 5 and 2. **Score:** "), "digit").alias("content"),
        F.expr(f"""array(struct('Thoughts on 5 and 2. ' AS token, -0.5D AS logprob, {none} AS top_logprobs),
            struct('**Score:** ' AS token, -0.25D AS logprob, {none} AS top_logprobs),
            struct(digit AS token, element_at(alts, CAST(digit AS INT)).logprob AS logprob, alts AS top_logprobs))""").alias("tokens"),
    )


JUDGEMENTS_SQL = "judged AS (SELECT vec_id, CAST(label % 5 + 1 AS INT) AS digit, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS l{i}" for i in range(1, 6)) + " FROM embeddings)"
