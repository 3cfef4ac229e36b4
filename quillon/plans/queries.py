"""Registered queries over the engine's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, logprobs
from ..functions import text as T
from ..operators import audit, batches, bootstrap, compare, latest, resume, sampling, scoring, selection, tables
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


_NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9.+\-/%]+', ' ', 'g'))"
_TOKENS = r"list_filter(string_split(" + _NORM + r", ' '), lambda t: t <> '')"
_NUMBERS = r"regexp_extract_all({}, '[-+]?[0-9]+(?:\.[0-9]+)?')"

_FINALS = f"""{A.SCORES_SQL}, need AS (SELECT question_type, count(*) AS k FROM rubric GROUP BY 1), finals AS (
  SELECT record_id, mode, question_type, sum(score * weight) AS final FROM scores JOIN need USING (question_type)
  WHERE score IS NOT NULL GROUP BY record_id, mode, question_type, k HAVING count(*) = k)"""


# Score tables


@query(f"""WITH {_FINALS}, long AS (
  SELECT mode, question_type || '/final' AS metric, final AS value FROM finals UNION ALL
  SELECT s.mode, s.question_type || '/' || dimension, score FROM scores s JOIN finals f ON s.record_id = f.record_id AND s.mode = f.mode
), means AS (SELECT mode, metric, avg(value) AS value FROM long GROUP BY 1, 2)
SELECT mode, metric, round(value, 6) AS value FROM means UNION ALL
SELECT mode, 'macro_final', round(avg(value), 6) FROM means WHERE metric LIKE '%/final' GROUP BY 1""")
def weighted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of complete records' weighted finals, of dimensions, and macro finals, by mode."""
    return tables.weighted_table(A.scores(spark, sf_dir)).select("mode", "metric", r6("value"))


@query(f"""WITH {_FINALS} SELECT mode, round(avg(v), 6) AS macro_final FROM (SELECT mode, question_type, avg(final) AS v FROM finals GROUP BY 1, 2) GROUP BY 1""")
def macro_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro final of each mode."""
    table = tables.weighted_table(A.scores(spark, sf_dir)).filter("metric = 'macro_final'")
    return table.select("mode", F.round("value", 6).alias("macro_final"))


@query(f"""WITH {_FINALS} SELECT o.mode, count(*) AS n, round(avg(o.final - b.final), 6) AS mean_diff
FROM finals o JOIN finals b ON o.record_id = b.record_id AND b.mode = 'base' WHERE o.mode <> 'base' GROUP BY 1""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each mode to the base mode over shared records."""
    return tables.paired_differences(A.scores(spark, sf_dir)).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff"))


@query()
def bootstrap_ci_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired differences with the draws of Python's generator."""
    diffs = tables.paired_differences(A.scores(spark, sf_dir))
    return bootstrap.exact_intervals(diffs, "mode", "diff", ["record_id"], samples=1000)


@query()
def bootstrap_ci_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired differences from 10,000 rounds of split counts."""
    return bootstrap.split_intervals(tables.paired_differences(A.scores(spark, sf_dir)), "mode", "diff", samples=10_000)


_HASHED = "CAST('0x' || substr(md5('72|' || mode || '|' || b || '|' || i), 1, 15) AS BIGINT) % n"


@query(f"""WITH {_FINALS}, v AS (
  SELECT o.mode, o.final - b.final AS v, row_number() OVER (PARTITION BY o.mode ORDER BY o.record_id) - 1 AS i, count(*) OVER (PARTITION BY o.mode) AS n
  FROM finals o JOIN finals b ON o.record_id = b.record_id AND b.mode = 'base' WHERE o.mode <> 'base'
), d AS (SELECT mode, b, {_HASHED} AS i FROM v, range(1000) AS r(b)), m AS (SELECT d.mode, b, avg(v.v) AS m FROM d JOIN v ON d.mode = v.mode AND d.i = v.i GROUP BY 1, 2),
s AS (SELECT mode, list(m ORDER BY m) AS s FROM m GROUP BY 1)
SELECT mode, any_value(n) AS n, round(avg(v), 6) AS mean, round(any_value(s.s[26]), 6) AS low, round(any_value(s.s[976]), 6) AS high FROM v JOIN s USING (mode) GROUP BY mode""")
def bootstrap_ci_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired differences with independent draws, in DataFrame functions."""
    diffs = tables.paired_differences(A.scores(spark, sf_dir))
    return bootstrap.hashed_intervals(diffs, "mode", "diff", ["record_id"], samples=1000).select("mode", "n", r6("mean"), r6("low"), r6("high"))


# Series


@query(f"WITH {A.QA_SQL} SELECT record_id, question, reply FROM qa")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and the turn that answers each."""
    return A.qa(spark, sf_dir).select("record_id", "question", "reply")


@query(f"""WITH {A.POINTS_SQL} SELECT series, pos // 16 AS window_index, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high
FROM points GROUP BY 1, 2""")
def series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every 16-step window of every series."""
    points = A.series_points(spark, sf_dir).withColumn("window_index", F.floor(F.col("pos") / 16))
    return points.groupBy("series", "window_index").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )


@query(f"""WITH {A.SERIES_SQL}, w AS (SELECT series, unnest(range(CAST(ceil(n / 16.0) AS BIGINT))) AS k, vals FROM series)
SELECT series, k AS window_index, list_aggregate(list_transform(vals[k * 16 + 1 : k * 16 + 16], lambda x: printf('%.0f', CAST(CAST(x AS FLOAT) AS DOUBLE) * 100)), 'string_agg', ', ') AS text FROM w""")
def window_slice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every 16-step window as text."""
    df = _windows(spark, sf_dir)
    return df.select("series", "window_index", arrays.values_text(F.col("values")).alias("text"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, window_index, values) of 16 steps each: no series is ever one row."""
    points = A.series_points(spark, sf_dir).withColumn("window_index", F.floor(F.col("pos") / 16))
    steps = points.groupBy("series", "window_index").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("steps"))
    return steps.select("series", "window_index", F.transform("steps", lambda x: x["value"]).alias("values"))


@query(f"""WITH {A.SERIES_SQL} SELECT series, CAST(ceil(n / 16.0) AS BIGINT) AS patches, CAST(ceil(n / 16.0) * 16 - n AS BIGINT) AS padding, round(list_sum(vals), 6) AS total FROM series""")
def patch_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded patches of every series: their number, padding and total, and that all are valid."""
    df = _windows(spark, sf_dir)
    patch, mask = F.get(arrays.patches(F.col("values"), 16), F.lit(0)), arrays.validity(F.col("values"), 16)
    df = df.select("series", patch.alias("patch"), mask.alias("mask"), F.get(arrays.patch_mask(mask, 16), F.lit(0)).alias("valid"))
    return df.groupBy("series").agg(
        F.count_if("valid").alias("patches"), F.sum(F.size("patch") - F.size(F.filter("mask", lambda x: x))).alias("padding"),
        F.round(F.sum(F.aggregate("patch", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"),
    )


@query(f"""WITH {A.SERIES_SQL}, m AS (SELECT max(n) AS top FROM series)
SELECT series, top AS length, n AS valid, round(list_sum(vals), 6) AS total FROM series, m""")
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series padded to the longest, with its mask."""
    df = A.series(spark, sf_dir)
    top = df.agg(F.max("n")).first()[0] or 0  # one number
    df = df.select("series", arrays.padded(F.col("values"), top).alias("v"), arrays.validity(F.col("values"), top).alias("m"))
    return df.select(
        "series", F.size("v").cast("long").alias("length"), F.size(F.filter("m", lambda x: x)).cast("long").alias("valid"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query(f"""WITH {A.SERIES_SQL}, b AS (SELECT series, n, (row_number() OVER (ORDER BY n DESC, series) - 1) // 8 AS batch, (row_number() OVER (ORDER BY series) - 1) // 8 AS dealt, list_sum(vals) AS s FROM series),
d AS (SELECT sum(longest * k) AS steps FROM (SELECT max(n) AS longest, count(*) AS k FROM b GROUP BY dealt))
SELECT batch, count(*) AS series, max(n) AS longest, CAST(sum(n) AS BIGINT) AS valid, CAST(max(n) * count(*) - sum(n) AS BIGINT) AS padding, round(1 - sum(n) / (max(n) * count(*)), 6) AS share,
round(sum(s), 6) AS total, CAST(any_value(d.steps) AS BIGINT) AS steps_in_order FROM b, d GROUP BY batch""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight series of about one length: steps, padding and its share; and all steps of batches dealt in order."""
    points = A.series_points(spark, sf_dir)
    lengths = points.groupBy("series").agg(F.count("*").alias("n"))
    batch = batches.by_length(lengths, "series", "n", 8)
    patches = batches.padded_patches(points, batch, "series", 16)
    valid = F.size(F.filter("mask", lambda x: x))
    out = patches.groupBy("batch").agg(
        F.count_distinct("series").alias("series"), F.sum(valid).alias("valid"), F.sum(F.size("mask") - valid).alias("padding"),
        F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)), 6).alias("total"),
    ).withColumn("share", F.round(F.col("padding") / (F.col("valid") + F.col("padding")), 6))
    longest = batch.groupBy("batch").agg(F.max("longest").alias("longest"))
    dealt = batches.in_order(lengths, "series", "n", 8).agg(F.sum("longest").alias("steps_in_order"))
    return out.join(longest, "batch").crossJoin(dealt)  # one row


@query(f"""WITH {A.POINTS_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY pos) AS last FROM points)
SELECT series, round(avg(pow(value - last, 2)) FILTER (WHERE last IS NOT NULL AND event_type <> 'error'), 6) AS loss FROM p GROUP BY 1""")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of predicting each value by the one before, errors masked out."""
    df = A.series_points(spark, sf_dir).withColumn("last", F.lag("value").over(Window.partitionBy("series").orderBy("pos")))
    mask = F.col("last").isNotNull() & (F.col("event_type") != "error")
    return df.groupBy("series").agg(F.round(arrays.masked_mse(F.col("value"), F.col("last"), mask), 6).alias("loss"))


_LOGITS = ", ".join(f"l{i}" for i in range(1, 6))


@query(f"""WITH {A.JUDGEMENTS_SQL} SELECT digit, count(*) AS n, round(avg(ln({" + ".join(f"exp(l{i})" for i in range(1, 6))}) - [{_LOGITS}][digit]), 6) AS loss FROM judged GROUP BY 1""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross entropy of five logits against the label."""
    df = A.table(spark, sf_dir, "embeddings").withColumn("digit", (F.col("label") % 5 + 1).cast("int"))
    logits = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return df.groupBy("digit").agg(F.count("*").alias("n"), F.round(F.avg(arrays.cross_entropy(logits, F.col("digit") - 1)), 6).alias("loss"))


@query("""WITH s AS (SELECT user_id, count(*) AS steps, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY 1)
SELECT user_id, steps, round(steps / greatest(seconds, 1), 9) AS per_second, round((28500 - steps) * greatest(seconds, 1) / steps / 3600, 4) AS hours_left FROM s""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps a second of each series, and the hours that 28500 steps leave."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    df = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("steps"), (F.max(ts) - F.min(ts)).alias("seconds"))
    span = F.greatest("seconds", F.lit(1.0))
    return df.select("user_id", "steps", F.round(F.col("steps") / span, 9).alias("per_second"), F.round((28500 - F.col("steps")) * span / F.col("steps") / 3600, 4).alias("hours_left"))


# Text scores


@query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS norm_sha256, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def normalize_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the normalized text of every document, and its tokens."""
    c = F.col("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(c), 256).alias("norm_sha256"), F.size(T.tokenize(c)).cast("long").alias("n_tokens"))


def _f1_sql(parts: str, empty: str) -> str:
    return f"""WITH {A.PREDICTIONS_SQL}, t AS (SELECT record_id, mode, {parts.format('response')} AS p, {parts.format('answer')} AS r FROM predictions WHERE question_type = 'open_ended'),
a AS (SELECT record_id, mode, u AS tok, count(*) AS n FROM (SELECT record_id, mode, unnest(p) AS u FROM t) GROUP BY 1, 2, 3),
b AS (SELECT record_id, mode, u AS tok, count(*) AS n FROM (SELECT record_id, mode, unnest(r) AS u FROM t) GROUP BY 1, 2, 3),
c AS (SELECT a.record_id, a.mode, sum(least(a.n, b.n)) AS k FROM a JOIN b ON a.record_id = b.record_id AND a.mode = b.mode AND a.tok = b.tok GROUP BY 1, 2)
SELECT t.record_id, t.mode, round(CASE WHEN len(p) = 0 AND len(r) = 0 THEN {empty} WHEN k IS NULL THEN 0 ELSE 2.0 * k / (len(p) + len(r)) END, 6) AS f1
FROM t LEFT JOIN c ON t.record_id = c.record_id AND t.mode = c.mode"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.predictions(spark, sf_dir).filter("question_type = 'open_ended'")


@query(_f1_sql(_TOKENS, "1"))
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of every open answer."""
    return _open(spark, sf_dir).select("record_id", "mode", F.round(T.token_f1(F.col("response"), F.col("answer")), 6).alias("f1"))


@query(_f1_sql(_NUMBERS, "NULL"))
def numeric_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the numbers of every open answer."""
    return _open(spark, sf_dir).select("record_id", "mode", F.round(T.numeric_f1(F.col("response"), F.col("answer")), 6).alias("f1"))


#: Longest common subsequences of the lists p and q of the rows of t: rows of the table of lengths, each from the one before, of all pairs at once.
_LCS_SQL = """pairs AS (SELECT row_number() OVER () AS pair, record_id, mode, p, q FROM t WHERE question_type = 'open_ended'),
pt AS (SELECT pair, generate_subscripts(p, 1) AS i, unnest(p) AS a FROM pairs), qt AS (SELECT pair, generate_subscripts(q, 1) AS j, unnest(q) AS b FROM pairs),
step(pair, i, j, v) AS (SELECT pair, CAST(0 AS BIGINT), j, CAST(0 AS BIGINT) FROM qt UNION ALL
  SELECT pair, i, j, max(greatest(v, d)) OVER (PARTITION BY pair ORDER BY j) FROM (
    SELECT s.pair, pt.i, s.j, s.v, coalesce(lag(s.v) OVER (PARTITION BY s.pair ORDER BY s.j), 0) + CAST(pt.a = qt.b AS BIGINT) AS d
    FROM step s JOIN pt ON pt.pair = s.pair AND pt.i = s.i + 1 JOIN qt ON qt.pair = s.pair AND qt.j = s.j)),
lcs AS (SELECT record_id, mode, max(v) AS l FROM step JOIN pairs USING (pair) GROUP BY 1, 2)"""


def _f1_of(common: str, p: str, r: str) -> str:
    return f"CASE WHEN len({p}) = 0 AND len({r}) = 0 THEN 1 WHEN {common} = 0 THEN 0 ELSE 2.0 * {common} / (len({p}) + len({r})) END"


def _shared(p: str, r: str) -> str:
    count = lambda x: f"len(list_filter({x}, lambda u: u = t))"
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least({count(p)}, {count(r)}))), 0)"


@query(f"""WITH RECURSIVE {A.PREDICTIONS_SQL}, t AS (SELECT record_id, mode, question_type, {_TOKENS.format('response')} AS p, {_TOKENS.format('answer')} AS q FROM predictions),
{_LCS_SQL}, c AS (SELECT t.*, coalesce(l, 0) AS k FROM t LEFT JOIN lcs USING (record_id, mode) WHERE question_type = 'open_ended') SELECT record_id, mode, round({_f1_of('k', 'p', 'q')}, 6) AS f1 FROM c""")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L F1 of every open answer."""
    return _open(spark, sf_dir).select("record_id", "mode", F.round(T.rouge_l_f1(F.col("response"), F.col("answer")), 6).alias("f1"))


_RE2 = lambda c, p: f"nullif(regexp_extract({c}, '{p}', 1), '')"
_CHOICE = lambda c: "upper(coalesce(" + ", ".join(
    [_RE2(c, r"(?i)^([A-D])\s*[).:\-]"), _RE2(c, r"(?i)\b(?:answer|option|choice)\s*(?:is|:)?\s*([A-D])\b"), _RE2(c, r"(?i)\b([A-D])\s*(?:is correct|is the correct|seems correct)\b"),
     _RE2(c, r"(?i)\bthe correct answer is\s*([A-D])\b"), f"CASE WHEN length({c}) <= 20 THEN {_RE2(c, r'(?i)\b([A-D])\b')} END"]) + "))"
#: DuckDB's word border knows ASCII only, so both engines read normalized text here.
_PREDICTED = f"SELECT record_id, mode, {_NORM.format('answer')} AS a, {_NORM.format('response')} AS r FROM predictions"


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, {_CHOICE('a')} AS gold, {_CHOICE('r')} AS pred FROM ({_PREDICTED} WHERE question_type = 'multiple_choice')")
def extract_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option named by answer and response of every choice question, after normalization."""
    df = A.predictions(spark, sf_dir).filter("question_type = 'multiple_choice'")
    norm = lambda c: T.extract_choice(T.normalize_text(F.col(c)))
    return df.select("record_id", "mode", norm("answer").alias("gold"), norm("response").alias("pred"))


_VERDICT = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {str(v).lower()}" for p, v in T.VERDICT_PATTERNS) + " END"


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, {_VERDICT('a')} AS gold, {_VERDICT('r')} AS pred FROM ({_PREDICTED} WHERE question_type = 'true_false')")
def extract_true_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of answer and response of every true/false question."""
    df = A.predictions(spark, sf_dir).filter("question_type = 'true_false'")
    return df.select("record_id", "mode", T.extract_true_false(F.col("answer")).alias("gold"), T.extract_true_false(F.col("response")).alias("pred"))


_JUDGED_TEXT = "question || ' Score: 2 but **Score:** [' || CAST(CAST(loss AS INT) AS STRING) || '] ' || response"
_JUDGED_SQL = "question || ' Score: 2 but **Score:** [' || CAST(CAST(floor(loss) AS INT) AS VARCHAR) || '] ' || response"
_SCORE_RE = r"(?i)(?:\*\*)?Score(?:\*\*)?\s*:\s*(?:\*\*)?\s*\[?([1-5])"


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, CAST(list_last(regexp_extract_all({_JUDGED_SQL}, '{_SCORE_RE}', 1)) AS INT) AS score FROM predictions")
def score_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last written score of a text around every response."""
    return A.predictions(spark, sf_dir).select("record_id", "mode", T.score_from_text(F.expr(_JUDGED_TEXT)).alias("score"))


@query("""WITH s AS (SELECT DISTINCT source, lang FROM documents), n AS (
  SELECT source, lang, regexp_replace(regexp_replace(lower(t), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM s, (VALUES ('Multiple Choice'), ('true/false?'), ('Open-Ended'), ('7')) AS v(x), LATERAL (SELECT x || ' ' || source AS t) UNION ALL
  SELECT source, lang, regexp_replace(regexp_replace(lower(x), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g') FROM s, (VALUES ('Multiple Choice'), ('true/false?'), ('Open-Ended'), ('7')) AS v(x))
SELECT CASE replace(s, '_', '') WHEN 'multiplechoice' THEN 'multiple_choice' WHEN 'openended' THEN 'open_ended' WHEN 'truefalse' THEN 'true_false' ELSE s END AS question_type, count(*) AS n FROM n GROUP BY 1""")
def normalize_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question types in many spellings, by normalized name."""
    names = F.explode(F.array(*map(F.lit, ("Multiple Choice", "true/false?", "Open-Ended", "7"))))
    df = A.table(spark, sf_dir, "documents").select("source", "lang").distinct().withColumn("x", names)
    df = df.withColumn("t", F.explode(F.array("x", F.concat_ws(" ", "x", "source"))))
    return df.groupBy(T.normalize_type(F.col("t")).alias("question_type")).agg(F.count("*").alias("n"))


_SCORED = f"""{A.PREDICTIONS_SQL}, t AS (SELECT *, {_TOKENS.format('response')} AS p, {_TOKENS.format('answer')} AS q, {_NUMBERS.format(_NORM.format('response'))} AS pn, {_NUMBERS.format(_NORM.format('answer'))} AS qn
  FROM predictions), {_LCS_SQL}, o AS (SELECT record_id, mode, {_f1_of('k', 'p', 'q')} AS token_f1, {_f1_of('l', 'p', 'q')} AS rouge_l_f1, CASE WHEN len(pn) + len(qn) > 0 THEN {_f1_of('m', 'pn', 'qn')} END AS numeric_f1,
  len(p) / greatest(len(q), 1) AS length_ratio FROM (SELECT *, {_shared('p', 'q')} AS k, coalesce(l, 0) AS l, {_shared('pn', 'qn')} AS m FROM t LEFT JOIN (SELECT record_id, mode, l FROM lcs) USING (record_id, mode) WHERE question_type = 'open_ended')),
c AS (SELECT record_id, mode, {_CHOICE('a')} AS gold_choice, {_CHOICE('r')} AS pred_choice FROM ({_PREDICTED} WHERE question_type = 'multiple_choice')),
v AS (SELECT record_id, mode, {_VERDICT('a')} AS gold_true_false, {_VERDICT('r')} AS pred_true_false FROM ({_PREDICTED} WHERE question_type = 'true_false')),
scored AS (SELECT p.record_id, p.mode, p.question_type, p.loss, c.gold_choice, c.pred_choice, v.gold_true_false, v.pred_true_false, token_f1, rouge_l_f1, numeric_f1, length_ratio,
  CASE WHEN gold_choice IS NOT NULL THEN CAST(pred_choice IS NOT DISTINCT FROM gold_choice AS DOUBLE) END AS choice_correct,
  CASE WHEN gold_true_false IS NOT NULL THEN CAST(pred_true_false IS NOT DISTINCT FROM gold_true_false AS DOUBLE) END AS true_false_correct,
  CASE p.question_type WHEN 'open_ended' THEN 0.5 * token_f1 + 0.5 * rouge_l_f1 WHEN 'multiple_choice' THEN choice_correct ELSE true_false_correct END AS primary_score
  FROM predictions p LEFT JOIN c USING (record_id, mode) LEFT JOIN v USING (record_id, mode) LEFT JOIN o USING (record_id, mode))"""
#: Added before rounding, so that halves that the engines reach by different sums round alike.
_NUDGE = 1e-9


def _r6(c: str):
    return F.round(F.col(c) + _NUDGE, 6).alias(c)


_NUMERIC = ["token_f1", "rouge_l_f1", "numeric_f1", "length_ratio", "primary_score"]


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with normalized texts, which both engines' patterns read alike."""
    df = A.predictions(spark, sf_dir)
    return df.withColumns({c: T.normalize_text(F.col(c)) for c in ("answer", "response")})


@query(f"""WITH RECURSIVE {_SCORED} SELECT record_id, mode, question_type, loss, gold_choice, pred_choice, gold_true_false, pred_true_false, {', '.join(f'round({c} + {_NUDGE}, 6) AS {c}' for c in _NUMERIC)} FROM scored""")
def score_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of every prediction, of normalized texts."""
    columns = ["gold_choice", "pred_choice", "gold_true_false", "pred_true_false"]
    return scoring.score_predictions(_normalized(spark, sf_dir)).select("record_id", "mode", "question_type", "loss", *columns, *map(_r6, _NUMERIC))


_MEANS = ["primary_score", "loss", "choice_correct", "true_false_correct", "token_f1", "rouge_l_f1", "numeric_f1"]


@query(f"""WITH RECURSIVE {_SCORED} SELECT question_type, count(*) AS n, {', '.join(f'round(avg({c}) + {_NUDGE}, 6) AS {c}' for c in _MEANS)},
CAST(count(*) FILTER (WHERE question_type = 'multiple_choice' AND pred_choice IS NULL OR question_type = 'true_false' AND pred_true_false IS NULL) AS BIGINT) AS unparsed FROM scored GROUP BY 1""")
def scored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all scores by question type."""
    out = scoring.scored_report(scoring.score_predictions(_normalized(spark, sf_dir)))
    return out.select("question_type", "n", *map(_r6, _MEANS), "unparsed")


@query(f"""WITH RECURSIVE {_SCORED}, k AS (SELECT question_type, count(*) AS n, avg(primary_score) AS p, sum(loss) AS l, count(loss) AS c FROM scored GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(avg(p), 6) AS macro_primary_score, round(sum(l) / sum(c), 6) AS loss FROM k""")
def overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, mean loss, and the mean of the types' mean primary scores."""
    return scoring.overall_report(scoring.score_predictions(_normalized(spark, sf_dir))).select("n", r6("macro_primary_score"), r6("loss"))


@query(f"""WITH {A.PREDICTIONS_SQL}, x AS (SELECT question_type, loss, CASE question_type WHEN 'true_false' THEN {_VERDICT('r')} IS NULL ELSE {_CHOICE('r')} IS NULL END AS u
  FROM (SELECT question_type, loss, {_NORM.format('response')} AS r FROM predictions) WHERE question_type <> 'open_ended')
SELECT question_type, count(*) AS n, round(avg(loss), 6) AS loss, CAST(count(*) FILTER (WHERE u) AS BIGINT) AS unparsed FROM x GROUP BY 1""")
def unparsed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed questions whose response states nothing, by type."""
    df = A.predictions(spark, sf_dir).filter("question_type <> 'open_ended'").withColumn("response", T.normalize_text(F.col("response")))
    return scoring.scored_report(scoring.score_predictions(df, rouge=False)).select("question_type", "n", r6("loss"), "unparsed")


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, sha256('Criterion: ' || question_type || chr(10) || 'Question: ' || question || chr(10) || 'Expected: ' || answer || chr(10) || 'Response: ' || response) AS prompt_sha256 FROM predictions""")
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each judge prompt."""
    prompt = F.format_string("Criterion: %s\nQuestion: %s\nExpected: %s\nResponse: %s", "question_type", "question", "answer", "response")
    return A.predictions(spark, sf_dir).select("record_id", "mode", F.sha2(prompt, 256).alias("prompt_sha256"))


# Joins and sets


@query(f"WITH {A.SCORES_SQL} SELECT p.record_id, p.mode, r.dimension FROM predictions p JOIN rubric r USING (question_type) WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.record_id = p.record_id AND s.mode = p.mode AND s.dimension = r.dimension AND s.score IS NOT NULL)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge tasks that have no score yet."""
    done = A.scores(spark, sf_dir).filter("score is not null")
    return resume.remaining(resume.judge_tasks(A.predictions(spark, sf_dir)), done).select("record_id", "mode", "dimension")


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, loss FROM predictions WHERE mode IN ('base', 'wo_windows') AND record_id IN (SELECT record_id FROM predictions GROUP BY 1 HAVING max(loss) >= 9)")
def manifest_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two modes whose record is in a manifest (records with a high loss)."""
    df = A.predictions(spark, sf_dir)
    manifest = df.groupBy("record_id").agg(F.max("loss").alias("top")).filter("top >= 9")
    return resume.only_records(df, manifest, ("base", "wo_windows")).select("record_id", "mode", "loss")


@query(f"WITH {A.SCORES_SQL} SELECT p.record_id, p.mode, r.dimension FROM predictions p JOIN rubric r USING (question_type)")
def expected_keys_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score key that a complete run has."""
    return audit.expected_scores(A.predictions(spark, sf_dir))


@query(f"WITH {A.SCORES_SQL} SELECT p.record_id, p.mode, r.dimension, 'right' AS side FROM predictions p JOIN rubric r USING (question_type) EXCEPT SELECT record_id, mode, dimension, 'right' FROM scores WHERE score IS NOT NULL")
def missing_keys_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score keys that only one side of (actual, expected) has."""
    return latest.key_difference(A.scores(spark, sf_dir).filter("score is not null"), audit.expected_scores(A.predictions(spark, sf_dir)), resume.TASK)


_TWO_RUNS = f"""{A.PREDICTIONS_SQL}, other AS (SELECT * REPLACE (CASE WHEN loss >= 6 THEN response ELSE response || ' Again.' END AS response) FROM predictions)"""


def _other(df: DataFrame) -> DataFrame:
    return df.withColumn("response", F.when(F.col("loss") >= 6, F.col("response")).otherwise(F.concat("response", F.lit(" Again."))))


@query(f"""WITH {_TWO_RUNS} SELECT count(*) AS shared, CAST(count(*) FILTER (WHERE p.response = o.response) AS BIGINT) AS exact, round(count(*) FILTER (WHERE p.response = o.response) / count(*), 6) AS fraction
FROM predictions p JOIN other o ON p.record_id = o.record_id AND p.mode = o.mode""")
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal responses of two runs."""
    df = A.predictions(spark, sf_dir)
    return compare.overlap_fraction(df, _other(df)).select("shared", "exact", r6("fraction"))


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, (row_number() OVER (ORDER BY record_id, mode) - 1) % 3 AS rank FROM predictions")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards dealt in turn, put together again."""
    shards = sampling.stride_shards(A.predictions(spark, sf_dir).select("record_id", "mode"), 3, ["record_id", "mode"])
    parts = [shards.filter(F.col("rank") == k) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("record_id", "mode", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {A.SCORES_SQL} SELECT record_id, mode, dimension, count(*) AS n FROM (SELECT * FROM scores UNION ALL SELECT * FROM scores WHERE score = 5) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur twice after a part of the scores is appended again."""
    df = A.scores(spark, sf_dir)
    return latest.duplicate_keys(df.unionByName(df.filter("score = 5")), resume.TASK)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last journal row of each key."""
    df = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return latest.latest(df, ["user_id", "event_type"], "event_id")


# Log-probabilities

_SOFT = ", ".join(f"exp(l{i} - greatest({_LOGITS})) AS w{i}" for i in range(1, 6))
_SOFT_SQL = f"""{A.JUDGEMENTS_SQL}, w AS (SELECT *, {_SOFT} FROM judged), soft AS (SELECT *, w1 + w2 + w3 + w4 + w5 AS z FROM w)"""
_MEAN = "(w1 + 2 * w2 + 3 * w3 + 4 * w4 + 5 * w5) / z"


@query(f"WITH {_SOFT_SQL} SELECT vec_id, round({_MEAN}, 6) AS score, {', '.join(f'round(w{i} / z, 6) AS p{i}' for i in range(1, 6))} FROM soft")
def final_score_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected score and distribution at the final score's token."""
    df = A.judgements(spark, sf_dir).withColumn("p", logprobs.final_distribution(F.col("content"), F.col("tokens")))
    return df.select("vec_id", F.round(logprobs.expectation(F.col("p")), 6).alias("score"), *(F.round(F.get("p", F.lit(i - 1)), 6).alias(f"p{i}") for i in range(1, 6)))


@query(f"""WITH {A.JUDGEMENTS_SQL}, e AS (SELECT *, greatest(l1, l2, l3, l4) AS peak FROM judged),
b AS (SELECT *, exp(l1 - peak) AS w1, exp(l2 - peak) AS w2, exp(l3 - peak) AS w3, exp(l4 - peak) AS w4, least({_LOGITS}) AS cutoff FROM e),
c AS (SELECT *, w1 + w2 + w3 + w4 AS z, exp(cutoff - peak) AS u FROM b)
SELECT vec_id, CASE WHEN digit < 5 AND u / (z + u) <= 0.17 THEN round((w1 + 2 * w2 + 3 * w3 + 4 * w4) / z, 6) END AS score,
  CASE WHEN digit < 5 AND u / (z + u) <= 0.17 THEN round(u / (z + u), 6) END AS missing_mass_bound FROM c""")
def bounded_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and bound where the fifth digit is displaced by another token; null beyond the bound or without the score."""
    hide = lambda a: F.struct(F.when(a["token"] == "5", "?").otherwise(a["token"]).alias("token"), a["logprob"].alias("logprob"))
    tokens = F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), t["logprob"].alias("logprob"), F.transform(t["top_logprobs"], hide).alias("top_logprobs")))
    df = A.judgements(spark, sf_dir).withColumn("content", F.when(~F.col("content").endswith("5"), F.col("content")).otherwise("no verdict")).withColumn("tokens", tokens)
    df = df.withColumn("b", logprobs.bounded_distribution(F.col("content"), F.col("tokens"), 5, 0.17))
    return df.select("vec_id", F.round("b.score", 6).alias("score"), F.round("b.missing_mass_bound", 6).alias("missing_mass_bound"))


@query(f"""WITH {A.JUDGEMENTS_SQL}, e AS (SELECT *, vec_id % 2 = 1 AS odd, CASE WHEN vec_id % 2 = 1 THEN greatest(l1, l2, l3, l4) ELSE greatest({_LOGITS}) END AS peak, least({_LOGITS}) AS cutoff FROM judged),
b AS (SELECT *, exp(l1 - peak) AS w1, exp(l2 - peak) AS w2, exp(l3 - peak) AS w3, exp(l4 - peak) AS w4, CASE WHEN odd THEN 0 ELSE exp(l5 - peak) END AS w5, CASE WHEN odd THEN exp(cutoff - peak) ELSE 0 END AS u FROM e),
c AS (SELECT *, w1 + w2 + w3 + w4 + w5 AS z, NOT (odd AND digit = 5) AS chosen FROM b)
SELECT vec_id, CASE WHEN chosen AND u / (z + u) <= 0.17 THEN round({_MEAN}, 6) END AS score, CASE WHEN chosen AND u / (z + u) <= 0.17 THEN CAST(odd AS INT) END AS missing FROM c""")
def readout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected score of a JSON readout with labels A to E, one of which is missing from every other answer."""
    label = lambda t: F.translate(t, "12345", "ABCDE")
    shown = lambda t: F.when((F.col("vec_id") % 2 == 1) & (label(t) == "E"), "?").otherwise(label(t))
    df = A.judgements(spark, sf_dir).withColumn("last", F.element_at("tokens", -1))
    alts = F.transform("last.top_logprobs", lambda a: F.struct(shown(a["token"]).alias("token"), a["logprob"].alias("logprob")))
    none = F.array().cast("array<struct<token:string,logprob:double>>")
    piece = lambda t, alts: F.struct(t.alias("token"), F.lit(-0.5).alias("logprob"), alts.alias("top_logprobs"))
    chosen = label(F.col("last.token"))
    df = df.withColumns(
        {"content": F.concat(F.lit('{"score":"'), chosen, F.lit('"}')), "tokens": F.array(piece(F.lit('{"score":"'), none), piece(chosen, alts), piece(F.lit('"}'), none))}
    ).withColumn("b", logprobs.bounded_labels(F.col("content"), F.col("tokens"), 5, 0.17))
    return df.select("vec_id", F.round("b.score", 6).alias("score"), F.col("b.missing").alias("missing"))


_RAISED = ", ".join(f"l{i} + CASE WHEN digit = {i} THEN 0.5 ELSE 0 END AS m{i}" for i in range(1, 6))


@query(f"""WITH {A.JUDGEMENTS_SQL}, m AS (SELECT vec_id, {_RAISED} FROM judged), w AS (SELECT vec_id, {', '.join(f'exp(m{i}) AS w{i}' for i in range(1, 6))} FROM m)
SELECT vec_id, round((w1 + 2 * w2 + 3 * w3 + 4 * w4 + 5 * w5) / (w1 + w2 + w3 + w4 + w5), 6) AS score, 'logprobs' AS method FROM w""")
def author_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected score over the digits at all positions, hinted ones raised."""
    df = A.judgements(spark, sf_dir).withColumn("d", logprobs.any_position_distribution(F.col("content"), F.col("tokens")))
    return df.select("vec_id", F.round("d.score", 6).alias("score"), F.col("d.method").alias("method"))


@query("SELECT vec_id, CAST(32 AS INT) AS score_offset, CAST(label % 5 + 1 AS VARCHAR) AS token FROM embeddings")
def token_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of the final score and the token that covers it."""
    df = A.judgements(spark, sf_dir).withColumn("score_offset", logprobs.score_offset(F.col("content")))
    return df.select("vec_id", "score_offset", logprobs.token_at(F.col("tokens"), F.col("score_offset"))["token"].alias("token"))


@query(f"WITH {A.JUDGEMENTS_SQL} SELECT CAST(least(l1, l2) >= 0 AS BOOLEAN) AS valid, count(*) AS n FROM (SELECT *, l1 + l2 + l3 + l4 + l5 AS s FROM judged) GROUP BY 1")
def distribution_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with keys 1..5 that are, or aren't, distributions."""
    pair = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    share = F.aggregate(pair, F.lit(0.0), lambda s, x: s + F.abs(x)) + 1
    values = F.transform(F.concat(pair, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), lambda x: x / share)
    df = A.table(spark, sf_dir, "embeddings").select(F.map_from_arrays(F.array(*map(F.lit, logprobs.DIGITS)), values).alias("d"))
    return df.groupBy(logprobs.valid_distribution(F.col("d")).alias("valid")).agg(F.count("*").alias("n"))


# Audits


@query(f"""WITH {A.SCORES_SQL}, e AS (SELECT p.record_id, p.mode, r.dimension FROM predictions p JOIN rubric r USING (question_type)), x AS (
  SELECT 'duplicate_keys' AS "check", count(*) AS bad FROM (SELECT 1 FROM scores GROUP BY record_id, mode, dimension HAVING count(*) > 1) UNION ALL
  SELECT 'score_not_numeric', count(*) FILTER (WHERE score IS NULL) FROM scores UNION ALL
  SELECT 'score_out_of_range', count(*) FILTER (WHERE score < 1 OR score > 5) FROM scores UNION ALL
  SELECT 'samples', count(*) FILTER (WHERE method LIKE 'exact_sample_mean_%') FROM scores UNION ALL
  SELECT 'missing_mass', count(*) FILTER (WHERE missing_score_mass_upper_bound > 1e-6) FROM scores UNION ALL
  SELECT 'prompt_hash', count(*) FILTER (WHERE NOT regexp_full_match(coalesce(prompt_sha256, ''), '[0-9a-f]{{64}}')) FROM scores UNION ALL
  SELECT 'method', count(*) FILTER (WHERE method = 'exact_sample_mean_5') FROM scores UNION ALL
  SELECT 'unexpected', count(*) FROM (SELECT record_id, mode, dimension FROM scores EXCEPT SELECT * FROM e) UNION ALL
  SELECT 'missing', count(*) FROM (SELECT * FROM e EXCEPT SELECT record_id, mode, dimension FROM scores))
SELECT "check", CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM x""")
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the score table."""
    df = A.scores(spark, sf_dir).withColumn("fallback_scores", F.array().cast("array<int>"))
    return audit.audit_scores(
        df, A.predictions(spark, sf_dir), allowed_methods=("exact_sample_mean_20", "final_score_top_logprobs"), most_missing=1e-6, need_hashes=True
    )


@query(f"""WITH {A.PREDICTIONS_SQL}, have AS (SELECT record_id, mode FROM predictions WHERE NOT (mode = 'wo_windows' AND loss > 8)), x AS (
  SELECT 'duplicate_keys' AS "check", count(*) AS bad FROM (SELECT 1 FROM have GROUP BY record_id, mode HAVING count(*) > 1) UNION ALL SELECT 'empty_response', count(*) FILTER (WHERE loss < 1) FROM predictions UNION ALL
  SELECT 'unexpected', count(*) FROM (SELECT * FROM have EXCEPT SELECT record_id, mode FROM predictions) UNION ALL SELECT 'missing', count(*) FROM predictions WHERE mode = 'wo_windows' AND loss > 8 UNION ALL
  SELECT 'record_ids', count(DISTINCT record_id) FROM predictions WHERE question_type = 'true_false')
SELECT "check", CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM x""")
def audit_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of a prediction table with blank and missing rows, against a short manifest."""
    df = A.predictions(spark, sf_dir).filter("not (mode = 'wo_windows' and loss > 8)")
    df = df.withColumn("response", F.when(F.col("loss") < 1, " \t").otherwise(F.col("response"))).unionByName(
        A.predictions(spark, sf_dir).filter("false")
    )
    manifest = A.qa(spark, sf_dir).join(A.predictions(spark, sf_dir).select("record_id", "question_type").distinct(), "record_id").filter("question_type <> 'true_false'")
    return audit.audit_predictions(df, manifest.select("record_id"))


@query(f"""WITH {A.PREDICTIONS_SQL}, base AS (SELECT * FROM predictions WHERE mode = 'base'), n AS (SELECT series_file, count(*) AS n FROM base GROUP BY 1), x AS (
  SELECT 'duplicate_keys' AS "check", count(*) AS bad FROM (SELECT 1 FROM base GROUP BY record_id, mode HAVING count(*) > 1) UNION ALL SELECT 'other_modes', count(*) FILTER (WHERE mode <> 'base') FROM base UNION ALL
  SELECT 'empty_response', count(*) FILTER (WHERE trim(response) = '') FROM base UNION ALL
  SELECT 'series', (SELECT count(DISTINCT conv_id) FROM conversations) - (SELECT count(*) FROM n) UNION ALL SELECT 'records_of_series', count(*) FILTER (WHERE n <> 2) FROM n)
SELECT "check", CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM x""")
def audit_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the base mode as a validation run over all conversations."""
    expected = A.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.expr(A._SERIES).alias("series_file"))
    return audit.audit_validation(A.predictions(spark, sf_dir).filter("mode = 'base'"), expected)


@query(f"WITH {A.SCORES_SQL} SELECT method AS value, count(*) AS n FROM scores GROUP BY 1")
def method_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by method."""
    return audit.histogram(A.scores(spark, sf_dir), "method")


# Comparison and selection

_RUNS = f"""{A.SCORES_SQL}, l AS (SELECT * FROM scores WHERE score IS NOT NULL), pairs AS (
  SELECT l.record_id, l.mode, l.dimension, l.score AS "left", CAST(1 + (CAST(l.score AS BIGINT) * 3 + l.mi) % 5 AS DOUBLE) AS "right", p.loss < 6 AS changed
  FROM l JOIN predictions p ON l.record_id = p.record_id AND l.mode = p.mode)"""
_SUMMARY = """count(*) AS n, round(avg("left"), 6) AS left_mean, round(avg("right"), 6) AS right_mean, round(avg("right" - "left"), 6) AS delta_mean, round(avg(abs("right" - "left")), 6) AS mean_absolute_delta,
  CAST(count(*) FILTER (WHERE "left" = "right") AS BIGINT) AS exact, CAST(count(*) FILTER (WHERE NOT changed) AS BIGINT) AS unchanged_same_prompt"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = A.scores(spark, sf_dir).filter("score is not null")
    right = left.withColumn("score", F.expr("CAST(1 + (CAST(score AS BIGINT) * 3 + mi) % 5 AS DOUBLE)"))
    predictions = A.predictions(spark, sf_dir)
    pairs = compare.score_pairs(left, right, predictions, _other(predictions))
    out = compare.summarize_scores(pairs)
    return out.select("bucket", "n", r6("left_mean"), r6("right_mean"), r6("delta_mean"), r6("mean_absolute_delta"), "exact", "unchanged_same_prompt")


@query(f"""WITH {_RUNS} SELECT 'overall' AS bucket, {_SUMMARY} FROM pairs UNION ALL SELECT CASE WHEN changed THEN 'changed' ELSE 'unchanged' END, {_SUMMARY} FROM pairs GROUP BY changed""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' scores: overall, and by whether the response changed."""
    return _compared(spark, sf_dir).filter("bucket not like 'dimension/%'")


@query(f"""WITH {_RUNS} SELECT 'dimension/' || dimension AS bucket, {_SUMMARY} FROM pairs GROUP BY dimension""")
def compare_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' scores by dimension."""
    return _compared(spark, sf_dir).filter("bucket like 'dimension/%'")


@query(f"""WITH {_TWO_RUNS} SELECT p.question_type, count(*) AS n, CAST(count(*) FILTER (WHERE p.response = o.response) AS BIGINT) AS exact, CAST(count(*) FILTER (WHERE p.response <> o.response) AS BIGINT) AS changed,
  round(avg(length(p.response)), 6) AS left_length, round(avg(length(o.response)), 6) AS right_length FROM predictions p JOIN other o ON p.record_id = o.record_id AND p.mode = o.mode GROUP BY 1""")
def compare_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' responses by question type."""
    df = A.predictions(spark, sf_dir)
    out = compare.summarize_predictions(compare.prediction_pairs(df, _other(df)))
    return out.select("question_type", "n", "exact", "changed", r6("left_length"), r6("right_length"))


@query()
def compare_predictions_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' responses by question type, with their likeness and mean scores."""
    df = A.predictions(spark, sf_dir)
    return compare.summarize_predictions(compare.prediction_pairs(df, _other(df), similarity=True))


@query("SELECT event_type AS candidate, count(*) AS n, round(avg(value), 6) AS mean_loss, round(median(value), 6) AS median_loss FROM events GROUP BY 1")
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mean and median loss of each candidate."""
    df = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("candidate"), F.col("value").alias("loss"))
    return selection.loss_summary(df, "candidate").select("candidate", "n", r6("mean_loss"), r6("median_loss"))


@query("""WITH s AS (SELECT event_type AS candidate, count(*) AS n, avg(value) AS mean_loss, median(value) AS median_loss FROM events GROUP BY 1)
SELECT candidate, n, round(mean_loss, 6) AS mean_loss, round(median_loss, 6) AS median_loss FROM s ORDER BY s.mean_loss, candidate LIMIT 1""")
def best_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of the least mean loss."""
    df = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("candidate"), F.col("value").alias("loss"))
    return selection.best_candidate(selection.loss_summary(df, "candidate"), "candidate").select("candidate", "n", r6("mean_loss"), r6("median_loss"))


@query(f"WITH {A.PREDICTIONS_SQL} SELECT mode, question_type, round(avg(loss), 6) AS mean_loss FROM predictions GROUP BY 1, 2")
def loss_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss by candidate and question type."""
    return selection.loss_by_type(A.predictions(spark, sf_dir), "mode").select("mode", "question_type", r6("mean_loss"))


# Order and sampling


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_name) - 1) % 4 AS rank FROM customer")
def stride_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt in turn to four shards, by name."""
    df = sampling.stride_shards(A.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 4, ["c_name"])
    return df.select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) - 1 < floor(count(*) OVER () * 0.95) THEN 'train' ELSE 'val' END AS split FROM orders")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two parts, by key."""
    return sampling.split(A.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 70 OFFSET (SELECT CAST(floor(count(*) * 0.02) AS BIGINT) FROM part)")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of 70 parts after the first 2 percent, by name."""
    return sampling.offset_limit(A.table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query("SELECT user_id, min(event_id) AS first, row_number() OVER (ORDER BY min(event_id)) - 1 AS position FROM events GROUP BY 1")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in the order in which they first occur."""
    return sampling.ordered_groups(A.table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "first", F.col("position").cast("long").alias("position"))


@query("SELECT user_id, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_done FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') BETWEEN 1 AND count(*) - 1")
def partial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that are done in part."""
    df = A.table(spark, sf_dir, "events").withColumn("done", F.col("event_type") == "purchase")
    return resume.partial_groups(df, "user_id", "done")
