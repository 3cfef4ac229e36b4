"""Registered queries of runs: comparison, judging through a recorded client, prompts and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, logprobs, prompts
from ..functions import text as T
from ..functions.similarity import text_similarity
from ..operators import audit, compare, judging, latest, resume, selection, tables
from ..scratch import shared_folder, written
from ..sources import jsonl
from ..streaming import journal, retries
from . import adapters as A
from .queries import _RUNS, _SOFT_SQL, _TWO_RUNS, _other, query, r6

# Comparison


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = A.scores(spark, sf_dir).filter("score is not null")
    right = left.withColumn("score", F.expr("CAST(1 + (CAST(score AS BIGINT) * 3 + mi) % 5 AS DOUBLE)"))
    predictions = A.predictions(spark, sf_dir)
    return compare.score_pairs(left, right, predictions, _other(predictions))


_SAMPLES = 500
_BUCKETS = f"""{_RUNS}, b AS (SELECT 'overall' AS bucket, * FROM pairs UNION ALL SELECT CASE WHEN changed THEN 'changed' ELSE 'unchanged' END, * FROM pairs UNION ALL SELECT 'dimension/' || dimension, * FROM pairs),
v AS (SELECT bucket, "right" - "left" AS v, row_number() OVER (PARTITION BY bucket ORDER BY record_id, mode, dimension) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b),
d AS (SELECT bucket, b, CAST('0x' || substr(md5('72|' || bucket || '|' || b || '|' || i), 1, 15) AS BIGINT) % n AS i FROM v, range({_SAMPLES}) AS r(b)),
m AS (SELECT d.bucket, b, avg(v.v) AS m FROM d JOIN v ON d.bucket = v.bucket AND d.i = v.i GROUP BY 1, 2), s AS (SELECT bucket, list(m ORDER BY m) AS s FROM m GROUP BY 1)"""


@query(f"""WITH {_BUCKETS} SELECT bucket, any_value(n) AS n, round(avg(v), 6) AS mean, round(any_value(s.s[{int(0.025 * (_SAMPLES - 1)) + 1}]), 6) AS low,
round(any_value(s.s[{int(0.975 * (_SAMPLES - 1)) + 1}]), 6) AS high FROM v JOIN s USING (bucket) GROUP BY bucket""")
def compare_delta_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two runs and its interval: overall, changed, unchanged and each dimension."""
    return compare.delta_intervals(_pairs(spark, sf_dir), _SAMPLES, draws="hashed").select("bucket", "n", r6("mean"), r6("low"), r6("high"))


@query()
def compare_delta_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 5,000 rounds of split counts, of which only sums are shuffled."""
    return compare.delta_intervals(_pairs(spark, sf_dir), 5000)


@query()
def compare_delta_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the draws of Python's generator, a seed a bucket."""
    return compare.delta_intervals(_pairs(spark, sf_dir), 1000, draws="exact")


@query(f"""WITH {_TWO_RUNS}, l AS (SELECT record_id, mode FROM predictions WHERE loss < 11), r AS (SELECT record_id, mode FROM predictions WHERE loss > 1),
d AS (SELECT 'left' AS side, record_id, mode FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', record_id, mode FROM (SELECT * FROM r EXCEPT SELECT * FROM l))
SELECT side, record_id, mode FROM d QUALIFY row_number() OVER (PARTITION BY side ORDER BY record_id, mode) <= 5""")
def first_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five keys that only one of two runs has, by side."""
    df = A.predictions(spark, sf_dir)
    return latest.first_of_difference(df.filter("loss < 11"), df.filter("loss > 1"), compare.PREDICTION).select("side", *compare.PREDICTION)


@query(f"""WITH {A.PREDICTIONS_SQL}, k AS (SELECT * FROM predictions WHERE loss < 11 UNION ALL SELECT * FROM predictions WHERE loss < 0.5), c AS (SELECT count(DISTINCT mode) AS c FROM k)
SELECT record_id, count(*) AS n, count(DISTINCT mode) AS candidates FROM k GROUP BY 1 HAVING count(*) <> (SELECT c FROM c) OR count(DISTINCT mode) <> (SELECT c FROM c)""")
def key_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that not every candidate has exactly once."""
    df = A.predictions(spark, sf_dir)
    rows = df.filter("loss < 11").unionByName(df.filter("loss < 0.5"))
    return selection.key_agreement(rows, "mode", ["record_id"])


@query(f"WITH {A.PREDICTIONS_SQL} SELECT question_type, count(*) AS pairs FROM predictions GROUP BY 1")
def type_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two runs by question type, after the check that both sides agree on it."""
    df = A.predictions(spark, sf_dir).withColumn("primary_score", F.lit(None).cast("double"))
    cols = lambda s: df.select(*compare.PREDICTION, *(F.col(c).alias(f"{s}_{c}") for c in ("question_type", "response")))
    pairs = compare.same_types(cols("left").join(cols("right"), compare.PREDICTION))
    return pairs.groupBy(F.col("left_question_type").alias("question_type")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, question_type AS "left", CASE WHEN loss > 11 THEN 'unknown' ELSE 'true_false' END AS "right" FROM predictions
WHERE loss > 11 OR (loss < 2 AND question_type <> 'true_false')""")
def type_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two runs that the check of types rejects: the second run lost or changed some types."""
    df = A.predictions(spark, sf_dir)
    other = F.when(F.col("loss") > 11, F.lit(None)).when(F.col("loss") < 2, "true_false").otherwise(F.col("question_type"))
    pairs = df.select(*compare.PREDICTION, F.col("question_type").alias("left_question_type")).join(df.select(*compare.PREDICTION, other.alias("right_question_type")), compare.PREDICTION)
    return compare.type_mismatches(pairs)


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, CASE WHEN loss > 11 THEN 'odd' END AS question_type FROM predictions WHERE loss > 11 OR loss < 1""")
def unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that can't be judged, as their type is missing or has no dimensions."""
    kind = F.when(F.col("loss") > 11, "odd").when(F.col("loss") >= 1, F.col("question_type"))
    return resume.unknown_types(A.predictions(spark, sf_dir).withColumn("question_type", kind)).select("record_id", "mode", "question_type")


@query(f"""WITH {A.SCORES_SQL}, d AS (SELECT record_id, mode, dimension, count(*) AS n FROM scores GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT p.record_id, p.mode, r.dimension FROM (SELECT DISTINCT a.record_id, m.mode FROM predictions a, (SELECT DISTINCT mode FROM predictions) m) p
  JOIN (SELECT DISTINCT record_id, mode, question_type FROM predictions) k USING (record_id, mode) JOIN rubric r ON r.question_type = k.question_type),
x AS (
  SELECT 'duplicate_keys' AS "check", count(*) AS bad FROM d UNION ALL
  SELECT 'score_not_numeric', count(*) FILTER (WHERE score IS NULL) FROM scores UNION ALL
  SELECT 'score_out_of_range', count(*) FILTER (WHERE score < 1 OR score > 5) FROM scores UNION ALL
  SELECT 'samples', count(*) FILTER (WHERE method LIKE 'exact_sample_mean_%') FROM scores UNION ALL
  SELECT 'prompt_hash', count(*) FILTER (WHERE NOT regexp_full_match(coalesce(prompt_sha256, ''), '[0-9a-f]{{64}}')) FROM scores UNION ALL
  SELECT 'unexpected', count(*) FROM (SELECT record_id, mode, dimension FROM scores EXCEPT SELECT * FROM e) UNION ALL
  SELECT 'missing', count(*) FROM (SELECT * FROM e EXCEPT SELECT record_id, mode, dimension FROM scores) UNION ALL
  SELECT 'mode', count(*) FILTER (WHERE mode <> 'base') FROM scores UNION ALL
  SELECT 'question_type', count(*) FILTER (WHERE question_type <> 'open_ended') FROM scores)
SELECT "check", CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM x""")
def audit_scores_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the score table, with the single values that two columns should have."""
    df = A.scores(spark, sf_dir).withColumn("fallback_scores", F.array().cast("array<int>"))
    return audit.audit_scores(df, A.predictions(spark, sf_dir), need_hashes=True, expected={"mode": "base", "question_type": "open_ended"})


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT mode, count(*) AS n, round(sum(loss), 6) AS total_loss, round(sum(loss) / greatest(count(*), 1), 6) AS average_loss FROM predictions GROUP BY 1
UNION ALL SELECT 'none', 0, 0, 0""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and average loss of each mode, and of a mode without rows."""
    df = A.predictions(spark, sf_dir)
    rows = selection.totals(df, ["mode"]).unionByName(selection.totals(df.filter("false"), []).withColumn("mode", F.lit("none")))
    return rows.select("mode", "n", r6("total_loss"), r6("average_loss"))


# A range of both texts gives its longest block and two smaller ranges; short texts have no popular characters.
@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part),
x AS (SELECT id, a, b, unnest(range(1, length(a) + 1)) AS i FROM p), y AS (SELECT id, a, b, i, unnest(range(1, length(b) + 1)) AS j FROM x), m AS (SELECT id, i, j FROM y WHERE a[i] = b[j]),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS run FROM m), runs AS (SELECT id, i, j, row_number() OVER (PARTITION BY id, i - j, run ORDER BY i) AS r FROM g),
q AS (
  SELECT id, 1 AS i0, length(a) + 1 AS i1, 1 AS j0, length(b) + 1 AS j1, 0 AS n FROM p UNION ALL
  SELECT id, c.i0, c.i1, c.j0, c.j1, c.n FROM (SELECT id, unnest([{'i0': i0, 'i1': e - k + 1, 'j0': j0, 'j1': f - k + 1, 'n': k}, {'i0': e + 1, 'i1': i1, 'j0': f + 1, 'j1': j1, 'n': 0}]) AS c FROM (
    SELECT id, i0, i1, j0, j1, best.k AS k, -best.i AS e, -best.j AS f FROM (SELECT q.id, i0, i1, j0, j1, max({'k': least(r, i - i0 + 1, j - j0 + 1), 'i': -i, 'j': -j}) AS best
      FROM q JOIN runs ON runs.id = q.id AND i >= i0 AND i < i1 AND j >= j0 AND j < j1 GROUP BY q.id, i0, i1, j0, j1))))
SELECT id AS p_partkey, round(CASE WHEN any_value(length(a) + length(b)) = 0 THEN 1 ELSE 2.0 * sum(n) / any_value(length(a) + length(b)) END, 6) AS similarity FROM q JOIN p USING (id) GROUP BY id""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each part's name and type, by longest blocks."""
    out = A.table(spark, sf_dir, "part").select("p_partkey", text_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))
    return out.select("p_partkey", r6("similarity"))


# Judging


def recorded_client(prompt: str, attempt: int) -> dict:
    """A judge that answers, fails once, fails for good or is never free, by the length of the prompt."""
    kind = len(prompt) % 4
    if kind == 2:
        raise judging.JudgeError(400)
    if kind == 3 or kind == 1 and attempt == 1:
        raise judging.JudgeError(503 if kind == 1 else 429)
    return {"choices": [{"message": {"content": f"Thus **Score:** {1 + len(prompt) % 5}"}}]}


def sampling_client(prompt: str, attempt: int) -> dict:
    """A judge whose every third answer states no score."""
    k = len(prompt) + attempt
    return {"choices": [{"message": {"content": "no verdict" if k % 3 == 0 else f"**Score:** {1 + k % 5}"}}]}


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.predictions(spark, sf_dir).select("record_id", "mode", F.lit("correctness").alias("dimension"), F.col("response").alias("prompt"))


_LEN = "length(response)"


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, CASE {_LEN} % 4 WHEN 2 THEN 'permanent' WHEN 3 THEN 'exhausted' ELSE 'done' END AS verdict,
CAST(CASE {_LEN} % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS BIGINT) AS attempts, CASE WHEN {_LEN} % 4 < 2 THEN 1 + {_LEN} % 5 END AS score FROM predictions""")
def judge_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, attempts and stated score of each task with three rounds at most."""
    out = judging.judge(_tasks(spark, sf_dir), recorded_client, max_rounds=3, sleep=lambda _: None)
    content = F.get_json_object("response", "$.choices[0].message.content")
    return out.select("record_id", "mode", "verdict", "attempts", F.nullif(T.score_from_text(content), F.lit(0)).cast("long").alias("score"))


@query(f"""WITH {A.PREDICTIONS_SQL}, t AS (SELECT record_id, mode, list_slice(list_filter(range(1, 101), lambda k: ({_LEN} + k) % 3 <> 0), 1, 20) AS ks, {_LEN} AS n FROM predictions)
SELECT record_id, mode, len(ks) AS samples, round(list_sum(list_transform(ks, lambda k: 1 + (n + k) % 5)) / 20.0, 6) AS score FROM t""")
def sampled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the first twenty stated scores of each task."""
    out = judging.sample_scores(_tasks(spark, sf_dir), sampling_client)
    return out.select("record_id", "mode", F.size("fallback_scores").cast("long").alias("samples"), r6("score"))


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT CASE WHEN {_LEN} % 3 = 0 THEN 'done' ELSE 'pending' END AS phase, mode, count(*) AS n FROM predictions WHERE {_LEN} % 3 = 0 OR {_LEN} % 4 <> 0 GROUP BY 1, 2""")
def two_phase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows with a distribution, and pending ones that state a score, by mode."""
    n = F.length("response")
    judged = A.predictions(spark, sf_dir).withColumn("content", F.when(n % 4 != 0, "**Score:** 3").otherwise("none"))
    done, pending = judging.two_phases(judged, F.when(n % 3 == 0, F.array(F.lit(1.0))))
    rows = done.select(F.lit("done").alias("phase"), "mode").unionByName(pending.select(F.lit("pending").alias("phase"), "mode"))
    return rows.groupBy("phase", "mode").agg(F.count("*").alias("n"))


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, CASE WHEN loss < 6 THEN 'done' ELSE 'pending' END AS sink FROM predictions""")
def stream_two_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of predictions, repeated in part, once by key in the sinks of done and pending rows."""
    folder = shared_folder(spark, "stream")
    df = A.predictions(spark, sf_dir).select("record_id", "mode", "loss")
    jsonl.write_jsonl(df, f"{folder}/in")
    jsonl.append_jsonl(df.filter("loss < 3"), f"{folder}/in")
    rows = journal.once_by_key(journal.read_stream(spark, f"{folder}/in", df.schema), compare.PREDICTION)
    journal.two_sinks(rows, F.col("loss") < 6, f"{folder}/done", f"{folder}/pending", f"{folder}/state").awaitTermination()
    read = lambda s: jsonl.read_jsonl(spark, f"{folder}/{s}", "record_id string, mode string, loss double").select(*compare.PREDICTION, F.lit(s).alias("sink"))
    return read("done").unionByName(read("pending"))


@query(f"""WITH {A.PREDICTIONS_SQL}, k AS (SELECT mode, count(*) AS n FROM predictions GROUP BY 1) SELECT CAST(sum(n) OVER () AS BIGINT) AS processed, 'done' AS state, CAST((SELECT count(*) FROM k) AS BIGINT) AS files FROM k LIMIT 1""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over one file a mode says of itself at its end: rows so far, state, and batches with rows."""
    folder = shared_folder(spark, "stream")
    # Written first: one task a file then only copies rows, and sorts nothing of what they are made of.
    df = written(A.predictions(spark, sf_dir).select("record_id", "mode", "loss"), "predictions")
    for mode in tables.MODES:
        jsonl.append_jsonl(df.filter(F.col("mode") == mode).coalesce(1), f"{folder}/in")
    rows = journal.once_by_key(journal.read_stream(spark, f"{folder}/in", df.schema, files=1), compare.PREDICTION)
    stream = journal.two_sinks(rows, F.col("loss") < 6, f"{folder}/done", f"{folder}/pending", f"{folder}/state")
    stream.awaitTermination()
    told = spark.createDataFrame(journal.progress(stream), "batch long, rows long, processed long, state string")
    return told.agg(F.max("processed").alias("processed"), F.max_by("state", "batch").alias("state"), F.count_if(F.col("rows") > 0).alias("files"))


#: Attempts recorded by the events: eight tasks a user, a code a kind of event.
_CODES = "CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 401 WHEN 'error' THEN 503 WHEN 'click' THEN 429 END"
_TASK = "CAST(user_id AS STRING) || ':' || CAST(event_id % 8 AS STRING)"


@query(f"""WITH a AS (SELECT {A.sql(_TASK)} AS task, ts, {_CODES} AS code FROM events),
k AS (SELECT *, row_number() OVER w AS k, lag(ts) OVER w AS last, lead(ts) OVER w AS next FROM a WINDOW w AS (PARTITION BY task ORDER BY ts)),
v AS (SELECT task, ts, k, CASE WHEN last + INTERVAL 2 DAY < ts THEN 'expired' WHEN code = 200 THEN 'done' WHEN code = 401 THEN 'permanent' WHEN k >= 3 THEN 'exhausted' END AS verdict,
  CASE WHEN last + INTERVAL 2 DAY < ts THEN k - 1 ELSE k END AS attempts FROM k UNION ALL
  SELECT task, ts + INTERVAL 2 DAY, k + 1, 'expired', k FROM k WHERE next IS NULL AND ts + INTERVAL 2 DAY <= (SELECT max(ts) FROM a))
SELECT task, verdict, CAST(attempts AS INT) AS attempts FROM v WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY k) = 1""")
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and attempts of each task from a stream of recorded attempts, which is stopped and started again."""
    folder = shared_folder(spark, "retries")
    df = A.table(spark, sf_dir, "events").select(F.expr(_TASK).alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_CODES).alias("code"))
    half = df.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).first()[0]
    for part in (df.filter(F.col("ts") < half), df.filter(F.col("ts") >= half)):
        part.write.mode("append").parquet(f"{folder}/in")
        rows = retries.verdicts(journal.read_stream(spark, f"{folder}/in", df.schema, "parquet"), most=3)
        retries.start(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(retries.VERDICTS).parquet(f"{folder}/out").select("task", "verdict", "attempts")


@query("SELECT n_regionkey * 5 + n_nationkey AS round, least(60.0, power(2.0, least(n_regionkey * 5 + n_nationkey, 5))) AS seconds FROM nation")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to wait after each of some rounds."""
    df = A.table(spark, sf_dir, "nation").select((F.col("n_regionkey") * 5 + F.col("n_nationkey")).alias("round"))
    return df.withColumn("seconds", judging.wait_column(F.col("round")))


# Prompts and requests

_TAIL_SQL = prompts.JUDGE_TAIL.replace("'", "''")


def _judge_sql(criterion: str, guide: str, gap: str) -> str:
    head = f"'{prompts.JUDGE_HEAD}{gap}{prompts.JUDGE_LENGTH}\n\n**Evaluation Criterion: ' || {criterion} || '**\nWhat counts.\n\n**Scoring Guidelines:**\n{guide}1: bad\n{guide}5: good'"
    return f"sha256({head} || '\n\n**Question:** ' || question || '{gap}**Expected Answer:** ' || answer || '{gap}**Generated Response:** ' || response || '\n\n{_TAIL_SQL}')"


@query(f"""WITH {A.SCORES_SQL} SELECT p.record_id, p.mode, r.dimension, {_judge_sql("replace(r.dimension, '_', ' ')", '', chr(10))} AS plain, {_judge_sql('r.dimension', 'Score ', chr(10) * 2)} AS author
FROM predictions p JOIN rubric r USING (question_type)""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the judge's prompts of every task, in both layouts."""
    df = A.predictions(spark, sf_dir).join(F.broadcast(tables.rubric(spark)), "question_type")
    guides = F.array(F.lit("1: bad"), F.lit("5: good"))
    prompt = lambda author: F.sha2(prompts.judge_prompt(F.col("dimension"), F.lit("What counts."), guides, F.col("question"), F.col("answer"), F.col("response"), author), 256)
    return df.select("record_id", "mode", "dimension", prompt(False).alias("plain"), prompt(True).alias("author"))


_I = prompts.QUESTION_INDENT


@query(f"""WITH {A.SERIES_SQL}, m AS (SELECT * FROM (VALUES ('base'), ('wo_fixed_hint'), ('wo_local_hint'), ('wo_windows')) AS v(mode)),
w AS (SELECT series, mode, least(16, n) AS e, list_aggregate(list_transform(vals[1:16], lambda x: printf('%.0f', CAST(CAST(x AS FLOAT) AS DOUBLE) * 100)), 'string_agg', ', ') AS t FROM series, m)
SELECT series, mode, sha256('\n{_I}{prompts.QUESTION_HEAD}\n\n{_I}### Time Series Data\n{_I}- **Window:** Steps 0 to ' || e || '\n{_I}- **Values (scaled by 100):** ' || CASE mode WHEN 'wo_windows' THEN '(removed)' ELSE t END
|| '\n\n{_I}### Contextual Hints\n{_I}- **Per-Step Analysis:** ' || CASE mode WHEN 'wo_local_hint' THEN '' ELSE repeat('<|local_hint|>', e) END || '\n{_I}- **Overall Summary Hints:** ' || CASE mode WHEN 'wo_fixed_hint' THEN '' ELSE repeat('<|fixed_hint|>', 3) END
|| '\n\n{_I}### Question\n{_I}What of series ' || series || '?\n{_I}') AS prompt_sha256, 'Answer: ' || series AS answer_prompt FROM w""")
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the question prompt of the first window of each series in each mode, and its answer prompt."""
    df = A.series(spark, sf_dir).withColumn("mode", F.explode(F.array(*map(F.lit, tables.MODES)))).withColumn("end", F.least(F.lit(16), F.col("n")))
    mode, number = F.col("mode"), F.col("series").cast("string")
    values = F.when(mode == "wo_windows", prompts.REMOVED).otherwise(arrays.values_text(arrays.window(F.col("values"), F.lit(0), F.col("end"))))
    local = arrays.hints("<|local_hint|>", F.col("end"), mode != "wo_local_hint")
    fixed = arrays.hints(prompts.FIXED_HINT, F.lit(3), mode != "wo_fixed_hint")
    prompt = prompts.question_prompt(F.lit(0), F.col("end"), values, local, fixed, F.concat(F.lit("What of series "), number, F.lit("?")))
    return df.select("series", "mode", F.sha2(prompt, 256).alias("prompt_sha256"), prompts.answer_prompt(number).alias("answer_prompt"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 8 AS INT) - 1 AS top, CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 5 END AS fallback, l_discount * 12 - 0.06 AS bound FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN top NOT BETWEEN 0 AND 5 THEN 'top_logprobs' END, CASE WHEN coalesce(fallback, -1) NOT IN (0, 20) THEN 'fallback_samples' END, CASE WHEN bound < 0 OR bound >= 1 THEN 'max_missing_score_mass' END) AS run_faults,
concat_ws(',', CASE WHEN top NOT BETWEEN 1 AND 5 THEN 'top_logprobs' END, CASE WHEN coalesce(fallback, -1) NOT IN (0, 20) THEN 'fallback_samples' END, CASE WHEN bound < 0 OR bound >= 1 THEN 'max_missing_score_mass' END) AS readout_faults FROM s""")
def rejected_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused of the settings of each run, and of a readout with the same settings."""
    df = A.table(spark, sf_dir, "lineitem")
    top = (F.col("l_partkey") % 8).cast("int") - 1
    fallback = F.when(F.col("l_suppkey") % 4 == 0, 0).when(F.col("l_suppkey") % 4 == 1, 20).when(F.col("l_suppkey") % 4 == 2, 5)
    faults = lambda readout: F.array_join(prompts.setting_faults(top, fallback, F.col("l_discount") * 12 - 0.06, readout), ",")
    return df.select("l_orderkey", "l_linenumber", faults(False).alias("run_faults"), faults(True).alias("readout_faults"))


_USER = """'{"role":"user","content":' || to_json(response) || '}'"""


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode,
'{{"model":"m","messages":[' || {_USER} || '],"temperature":0.0,"max_tokens":64,"seed":72,"logprobs":true,"top_logprobs":5,"enable_thinking":false}}' AS body,
'{{"model":"m","messages":[' || {_USER} || ',{{"role":"assistant","content":"B"}},{{"role":"user","content":"Say it."}}],"temperature":0.0,"max_tokens":8,"seed":72,"logprobs":true,"top_logprobs":5,"response_format":{{"type":"json_object"}}}}' AS readout
FROM predictions""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both requests of every response, as JSON."""
    c = F.col("response")
    return A.predictions(spark, sf_dir).select(
        "record_id", "mode", prompts.request_body("m", c, 0.0, 64, logprobs=True, top_logprobs=5, thinking=False).alias("body"),
        prompts.readout_body("m", c, F.lit("B"), "Say it.", 8).alias("readout"),
    )


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, '{{"choices":[{{"message":{{"content":' || to_json(CASE WHEN loss < 3 THEN '' ELSE response END) || '}}}}],"model":"' || mode || '"}}' AS compact FROM predictions""")
def compact_primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with only what a later fallback needs, as JSON without nulls."""
    content = F.when(F.col("loss") >= 3, F.col("response"))
    message = F.struct(content.alias("content"), F.lit("assistant").alias("role"))
    response = F.struct(
        F.array(F.struct(message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.col("mode").alias("model"),
        F.lit(None).cast("string").alias("system_fingerprint"), F.lit(None).cast("string").alias("usage"), F.lit("secret").alias("headers"),
    )
    return A.predictions(spark, sf_dir).withColumn("primary", response).select("record_id", "mode", F.to_json(prompts.compact_primary(F.col("primary"))).alias("compact"))


@query("""SELECT n_nationkey, 'Q' || n_name AS question, n_name AS answer, CAST(n_nationkey AS INT) AS start_index, CAST(n_nationkey + 4 AS INT) AS end_index, CASE WHEN n_nationkey % 2 = 0 THEN 'true_false' ELSE 'unknown' END AS question_type FROM nation
UNION ALL SELECT n_nationkey, 'R', 'S', 1, 2, 'unknown' FROM nation WHERE n_nationkey % 3 = 0""")
def analysis_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON texts that are objects or lists of objects."""
    item = F.struct(
        F.concat(F.lit("Q"), "n_name").alias("question"), F.col("n_name").alias("answer"), F.when(F.col("n_nationkey") % 2 == 0, "true_false").alias("question_type"),
        F.struct(F.col("n_nationkey").alias("start"), (F.col("n_nationkey") + 4).alias("end")).alias("window_range"),
    )
    one = F.to_json(item)
    more = F.concat(F.lit("["), one, F.lit(',{"question":"R","answer":"S","window_range":{"start":1,"end":2}}]'))
    df = A.table(spark, sf_dir, "nation").withColumn("j", F.when(F.col("n_nationkey") % 3 == 0, more).otherwise(one))
    return df.select("n_nationkey", F.inline(prompts.analysis_items(F.col("j"))))


@query("SELECT r_name, CASE r_regionkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS thinking FROM region")
def thinking_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a switch in several spellings."""
    value = F.element_at(F.array(F.lit("Auto"), F.lit("TRUE"), F.lit("false")), (F.col("r_regionkey") % 3 + 1).cast("int"))
    return A.table(spark, sf_dir, "region").select("r_name", prompts.thinking_of(value).alias("thinking"))


@query("SELECT user_id, repeat('<|local_hint|>', CAST(user_id % 7 AS INT)) AS local_hints, CASE WHEN user_id % 2 = 0 THEN repeat('<|fixed_hint|>', 4) ELSE '' END AS fixed_hints FROM (SELECT DISTINCT user_id FROM events)")
def hint_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of each series, repeated or turned off."""
    df = A.table(spark, sf_dir, "events").select("user_id").distinct()
    return df.select("user_id", arrays.hints("<|local_hint|>", F.col("user_id") % 7, F.lit(True)).alias("local_hints"), arrays.hints(prompts.FIXED_HINT, F.lit(4), F.col("user_id") % 2 == 0).alias("fixed_hints"))


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, regexp_replace(question, '[^A-Za-z0-9_.\\-]+', '_', 'g') AS name FROM predictions""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as names fit for a path."""
    return A.predictions(spark, sf_dir).select("record_id", "mode", T.safe_name(F.col("question")).alias("name"))


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '') AS host FROM pages")
def endpoint_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host (and port) of every page's address."""
    return A.table(spark, sf_dir, "pages").select("page_id", T.endpoint_host(F.col("url")).alias("host"))


@query(f"WITH {_SOFT_SQL} SELECT vec_id, {', '.join(f'round(w{i} / z, 6) AS p{i}' for i in range(1, 6))} FROM soft")
def fullest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution at the first token with all five digits, behind one that has three."""
    none = "struct(cast('x' as string) as token, cast(-0.5 as double) as logprob, filter(element_at(tokens, -1).top_logprobs, (a, i) -> i < 3) as top_logprobs)"
    df = A.judgements(spark, sf_dir).withColumn("tokens", F.concat(F.array(F.expr(none)), "tokens"))
    df = df.withColumn("p", logprobs.fullest_distribution(F.col("tokens")))
    return df.select("vec_id", *(F.round(F.get("p", F.lit(i - 1)), 6).alias(f"p{i}") for i in range(1, 6)))
