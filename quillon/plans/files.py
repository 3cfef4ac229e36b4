"""Registered queries of sources and sinks: what is written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, resume, sampling, tables
from ..scratch import shared_folder
from ..sources import jsonl, manifests, results, series
from . import adapters as A
from .queries import _FINALS, query

_ROW = "record_id string, mode string, response string, loss double"
_SERIES_NAME = "'series_' || lpad(CAST(series AS VARCHAR), 6, '0') || '.json'"
#: Windows of 16 steps; the last one may be shorter.
_WINDOWS_SQL = f"""{A.SERIES_SQL}, files AS (SELECT *, {_SERIES_NAME} AS series_file, dense_rank() OVER (ORDER BY {_SERIES_NAME}) - 1 AS series_index FROM series),
w AS (SELECT *, unnest(range(CAST(ceil(n / 16.0) AS BIGINT))) AS window_index FROM files)"""


def _short(df: DataFrame) -> DataFrame:
    return df.select("record_id", "mode", "response", "loss")


def _series_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON file for each series, windows of 16 steps with a question each."""
    df = A.series(spark, sf_dir)
    count = F.ceil(F.col("n") / 16).cast("int")
    window = lambda k: F.struct(
        F.concat(F.lit("What of window "), k.cast("string"), F.lit("?")).alias("question"), F.concat(F.lit("Part "), k.cast("string")).alias("answer"),
        F.when(k % 2 == 0, "open_ended").alias("question_type"), F.struct((k * 16).alias("start"), F.least(k * 16 + 16, F.col("n")).alias("end")).alias("window_range"),
        (k % 3 == 0).alias("has_anomaly"),
    )
    rows = df.select(
        F.concat(F.lit("series_"), F.lpad(F.col("series").cast("string"), 6, "0"), F.lit(".json")).alias("series_file"), F.col("series").cast("string").alias("sample_id"),
        F.struct(F.col("values").alias("time_series")).alias("original_data"), F.transform(F.sequence(F.lit(0), count - 1), window).alias("windows"),
    )
    folder = shared_folder(spark, "series")
    results.write_series(rows, folder, spread=True)
    return folder


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode, response, loss FROM predictions")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as JSON lines over an earlier file, and read back under their schema."""
    path = shared_folder(spark, "lines")
    df = _short(A.predictions(spark, sf_dir))
    jsonl.write_jsonl(df.limit(3), path)
    jsonl.write_jsonl(df, path)
    return jsonl.read_jsonl(spark, path, _ROW)


@query(f"WITH {A.PREDICTIONS_SQL} SELECT mode, count(*) AS n, round(sum(loss), 6) AS loss FROM predictions GROUP BY 1")
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes appended to one file of JSON lines, one after the other; rows and losses of each."""
    path = shared_folder(spark, "appended")
    df = _short(A.predictions(spark, sf_dir))
    for mode in tables.MODES:
        jsonl.append_jsonl(df.filter(F.col("mode") == mode), path)
    return jsonl.read_jsonl(spark, path, _ROW).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 6).alias("loss"))


@query(f"""WITH {A.PREDICTIONS_SQL}, k AS (SELECT record_id || ' ' || mode AS k FROM predictions)
SELECT count(*) AS n, min(k) AS first, max(k) AS last, CAST(0 AS BIGINT) AS out_of_order FROM k""")
def shard_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards written as one sorted file: its rows, its ends, and neighbours that are out of order."""
    df = sampling.stride_shards(_short(A.predictions(spark, sf_dir)), 3, ["record_id", "mode"])
    path = shared_folder(spark, "merged")
    jsonl.merge_shards([df.filter(F.col("rank") == k).drop("rank") for k in range(3)], path)
    rows = jsonl.read_jsonl(spark, path, _ROW, line_numbers=True).select(F.concat_ws(" ", "record_id", "mode").alias("k"), F.col("_line_no.file_name").alias("file"), "_line_no")
    # Within a file the next line must not be less; the files' ranges must not overlap.
    from pyspark.sql import Window

    after = rows.withColumn("next", F.lead("k").over(Window.partitionBy("file").orderBy("_line_no")))
    files = after.groupBy("file").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_if(F.col("next") < F.col("k")).alias("bad"))
    before = F.max("hi").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    files = files.withColumn("bad", F.col("bad") + F.coalesce((before > F.col("lo")).cast("long"), F.lit(0)))
    return files.agg(F.sum("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum("bad").alias("out_of_order"))


@query(f"""WITH {_WINDOWS_SQL} SELECT replace(series_file, '.json', '') || ':' || window_index AS record_id, series_file, CAST(series_index AS INT) AS series_index, CAST(window_index AS INT) AS window_index,
CAST(n AS BIGINT) AS steps, 'What of window ' || window_index || '?' AS question, 'Part ' || window_index AS answer, CASE WHEN window_index % 2 = 0 THEN 'open_ended' ELSE 'unknown' END AS question_type,
CAST(window_index * 16 AS INT) AS start_index, CAST(least(window_index * 16 + 16, n) AS INT) AS end_index, window_index % 3 = 0 AS has_anomaly FROM w""")
def series_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each window of each series file, in the order of the files' names."""
    out = series.load_records(spark, _series_folder(spark, sf_dir))
    return out.select("record_id", "series_file", "series_index", "window_index", F.size("time_series").cast("long").alias("steps"), "question", "answer", "question_type", "start_index", "end_index", "has_anomaly")


@query(f"""WITH {_WINDOWS_SQL} SELECT replace(series_file, '.json', '') || ':' || window_index AS record_id FROM w ORDER BY series_index, window_index LIMIT 25""")
def series_records_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 records of the series files (a limit is what this source offers)."""
    return series.load_records(spark, _series_folder(spark, sf_dir), max_records=25).select("record_id")


@query(f"""WITH {_WINDOWS_SQL} SELECT series_file, CAST(window_index AS INT) AS window_index, CAST(series_index AS INT) AS series_index, row_number() OVER (ORDER BY series_index, window_index) - 1 AS global_question_id FROM w""")
def record_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the series, of the window in it, and of the question among all."""
    records = series.load_records(spark, _series_folder(spark, sf_dir)).select("series_file", "series_index", "window_index")
    return sampling.numbered(records, ["series_index", "window_index"], "global_question_id")


def _shuffled_sql(seed: int) -> str:
    """CTE ``shuffled`` (series_file, position): the seeded shuffle of the table ``files``, word by word of its generator.

    The generator's state is made of the seed, renewed once and tempered: enough
    for some 400 names.
    """
    return f"""names AS (SELECT list(series_file ORDER BY series_file) AS x, count(*) AS n FROM files),
s0 AS (SELECT 0 AS i, 19650218::BIGINT AS v UNION ALL SELECT i + 1, (1812433253 * xor(v, v >> 30) + i + 1) % 4294967296 FROM s0 WHERE i < 623),
s1 AS (SELECT 0 AS s, 0::BIGINT AS one, v FROM s0 WHERE i = 0 UNION ALL
  SELECT s + 1, CASE WHEN s = 0 THEN w ELSE one END, w FROM (SELECT s, one, (xor(CASE WHEN s < 623 THEN s0.v ELSE one END, xor(s1.v, s1.v >> 30) * 1664525 % 4294967296) + {seed}) % 4294967296 AS w
    FROM s1 JOIN s0 ON s0.i = CASE WHEN s < 623 THEN s + 1 ELSE 1 END WHERE s < 624)),
m1 AS (SELECT CASE WHEN s = 624 THEN 1 ELSE s END AS i, v FROM s1 WHERE s >= 2),
s2 AS (SELECT 0 AS t, v FROM m1 WHERE i = 1 UNION ALL
  SELECT t + 1, (xor(m1.v, xor(s2.v, s2.v >> 30) * 1566083941 % 4294967296) - m1.i + 4294967296) % 4294967296 FROM s2 JOIN m1 ON m1.i = CASE WHEN t < 622 THEN t + 2 ELSE 1 END WHERE t < 623),
mt AS (SELECT 0 AS i, 2147483648::BIGINT AS v UNION ALL SELECT CASE WHEN t = 623 THEN 1 ELSE t + 1 END, v FROM s2 WHERE t > 0),
tw AS (SELECT a.i, xor(((a.v & 2147483648) | (b.v & 2147483647)) >> 1, CASE WHEN b.v % 2 = 1 THEN 2567483615 ELSE 0 END) AS f FROM mt a JOIN mt b ON b.i = a.i + 1),
n1 AS (SELECT tw.i, xor(f, v) AS v FROM tw JOIN mt ON mt.i = tw.i + 397 WHERE tw.i < 227),
n2 AS (SELECT tw.i, xor(f, v) AS v FROM tw JOIN n1 ON n1.i = tw.i - 227 WHERE tw.i < 454),
n3 AS (SELECT tw.i, xor(f, v) AS v FROM tw JOIN n2 ON n2.i = tw.i - 227),
t1 AS (SELECT i, xor(v, v >> 11) AS v FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3)),
t2 AS (SELECT i, xor(v, (v << 7) & 2636928640) AS v FROM t1), t3 AS (SELECT i, xor(v, (v << 15) & 4022730752) AS v FROM t2), words AS (SELECT i, xor(v, v >> 18) AS v FROM t3),
d AS (SELECT 0 AS t, n - 1 AS i, x FROM names UNION ALL
  SELECT t + 1, CASE WHEN r <= i THEN i - 1 ELSE i END, CASE WHEN r <= i THEN list_transform(x, lambda e, k: CASE k WHEN i + 1 THEN x[r + 1] WHEN r + 1 THEN x[i + 1] ELSE e END) ELSE x END
  FROM (SELECT d.t, d.i, d.x, v >> CAST(32 - length(bin(d.i + 1)) AS INT) AS r FROM d JOIN words ON words.i = d.t WHERE d.i >= 1)),
shuffled AS (SELECT unnest(x) AS series_file, unnest(range(len(x))) AS position FROM d WHERE i < 1)"""


_FILES_SQL = f"""{A.SERIES_SQL}, files AS (SELECT {_SERIES_NAME} AS series_file FROM series)"""


@query(f"""WITH RECURSIVE {_FILES_SQL}, {_shuffled_sql(42)} SELECT series_file, CASE WHEN position < floor((SELECT n FROM names) * 0.95) THEN 'train' ELSE 'val' END AS split FROM shuffled""")
def series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series files of the shuffled training and validation parts, by name."""
    folder = _series_folder(spark, sf_dir)
    part = lambda s: series.load_split(spark, folder, s).select("series_file", F.lit(s).alias("split"))
    return part("train").unionByName(part("val"))


@query(f"""WITH RECURSIVE {_FILES_SQL}, {_shuffled_sql(42)}, c AS (SELECT CAST(floor(n * 0.02) AS BIGINT) AS first FROM names)
SELECT series_file, CAST(position - first AS INT) AS series_index, CAST(ceil(n / 16.0) AS BIGINT) AS windows FROM shuffled JOIN (SELECT {_SERIES_NAME} AS series_file, n FROM series) s USING (series_file), c WHERE position >= first AND position < first + 70""")
def short_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of the short shuffled subset, by name and place, and their windows."""
    records = series.load_records(spark, _series_folder(spark, sf_dir), "paper140")
    return records.groupBy("series_file", "series_index").agg(F.count("*").alias("windows"))


@query(f"WITH {A.PREDICTIONS_SQL} SELECT DISTINCT record_id AS value FROM predictions WHERE question_type <> 'true_false' UNION SELECT DISTINCT series_file FROM predictions WHERE question_type <> 'true_false'")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a subset manifest that was written and read: its records and series files."""
    df = A.predictions(spark, sf_dir).filter("question_type <> 'true_false' and mode = 'base'")
    path = shared_folder(spark, "manifest")
    manifests.write_json(manifests.subset_manifest(df.select("record_id", "series_file", F.col("conv_id").alias("series_index"), F.col("turn").alias("window_index")), "closed"), path)
    return manifests.read_ids(spark, path, ("record_ids", "series_files"))


@query(f"""WITH RECURSIVE {_FILES_SQL}, {_shuffled_sql(72)}, c AS (SELECT CAST(floor(n * 0.95) AS BIGINT) AS train FROM names)
SELECT 72 AS seed, CASE WHEN position < train THEN 'train' ELSE 'val' END AS split, CAST(CASE WHEN position < train THEN position ELSE position - train END AS INT) AS place, series_file FROM shuffled, c""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split manifest, written and read: the name at each place of its lists."""
    names = A.table(spark, sf_dir, "events").select(F.expr("'series_' || lpad(CAST(user_id AS STRING), 6, '0') || '.json'").alias("series_file")).distinct()
    path = shared_folder(spark, "split")
    manifests.write_json(manifests.split_manifest(names, "series_file"), path)
    df = spark.read.schema("seed int, train_series array<string>, val_series array<string>").json(path)
    lists = [df.select("seed", F.lit(s).alias("split"), F.posexplode(f"{s}_series").alias("place", "series_file")) for s in ("train", "val")]
    return lists[0].unionByName(lists[1])


@query(f"WITH {A.PREDICTIONS_SQL} SELECT mode, count(*) AS n, round(sum(loss), 6) AS loss FROM predictions WHERE record_id IN (SELECT record_id FROM predictions WHERE question_type <> 'true_false') GROUP BY 1")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the records that a written manifest names, by mode."""
    df = A.predictions(spark, sf_dir)
    path = shared_folder(spark, "manifest")
    base = df.filter("question_type <> 'true_false' and mode = 'base'").select("record_id", "series_file", F.col("conv_id").alias("series_index"), F.col("turn").alias("window_index"))
    manifests.write_json(manifests.subset_manifest(base, "closed"), path)
    kept = resume.only_records(df, manifests.read_ids(spark, path).withColumnRenamed("value", "record_id"))
    return kept.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.sum("loss"), 6).alias("loss"))


_CELLS = [f"{k}/{part}" for k in ("multiple_choice", "open_ended", "true_false") for part in ("final", *sorted(d for kind, d, _ in tables.RUBRIC if kind == k))]


@query(f"""WITH {_FINALS}, long AS (SELECT mode, question_type || '/final' AS metric, final AS value FROM finals UNION ALL
  SELECT s.mode, s.question_type || '/' || dimension, score FROM scores s JOIN finals f ON s.record_id = f.record_id AND s.mode = f.mode), m AS (SELECT mode, metric, avg(value) AS v FROM long GROUP BY 1, 2)
SELECT '| ' || mode || ' | ' || {" || ' | ' || ".join(f"printf('%.2f', max(CASE WHEN metric = '{c}' THEN v END))" for c in _CELLS)} || ' |' AS line FROM m GROUP BY mode""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the Markdown report, with every dimension, written as text and read again."""
    return _report(spark, tables.weighted_table(A.scores(spark, sf_dir)), None).filter("line like '| %' and line not like '| mode %' and line not like '| ---%'")


@query()
def markdown_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the Markdown report with the paired differences from 10,000 rounds below it."""
    scores = A.scores(spark, sf_dir)
    intervals = bootstrap.split_intervals(tables.paired_differences(scores), "mode", "diff", samples=10_000)
    return _report(spark, tables.weighted_table(scores), intervals)


def _report(spark: SparkSession, table: DataFrame, intervals: DataFrame | None) -> DataFrame:
    path = shared_folder(spark, "report")
    spark.createDataFrame([(manifests.markdown_table(table, intervals),)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""WITH {_FINALS}, m AS (SELECT mode, question_type || '/final' AS metric, avg(final) AS value FROM finals GROUP BY 1, 2) SELECT mode, metric, round(value, 6) AS value FROM m""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of finals from a report that was written as JSON and read again."""
    path = shared_folder(spark, "report")
    manifests.write_json(tables.weighted_table(A.scores(spark, sf_dir)), path)
    df = jsonl.read_jsonl(spark, path, "mode string, metric string, value double")
    return df.filter("metric like '%/final'").select("mode", "metric", F.round("value", 6).alias("value"))


@query("SELECT 'r' || CAST(r_regionkey AS VARCHAR) || '.txt' AS name, length(r_name) + 1 AS length, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of files that hold one region's name each."""
    folder = shared_folder(spark, "files")
    rows = A.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".txt")).alias("name"), F.concat("r_name", F.lit("\n")).alias("text"))
    results.write_named(rows, folder)
    return manifests.file_digests(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query(f"""WITH {A.PREDICTIONS_SQL} SELECT '{{"modes": 4, "subset": "all"}}' AS settings, sha256('weights' || chr(10)) AS checkpoint_sha256, count(*) AS "rows" FROM predictions""")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of a run, written and read: settings, checkpoint digest and rows."""
    folder, path = shared_folder(spark, "checkpoint"), shared_folder(spark, "run")
    results.write_named(spark.createDataFrame([("model.bin", "weights\n")], "name string, text string"), folder)
    digest = manifests.file_digests(spark, folder).first()["sha256"]
    manifests.write_json(results.run_manifest(spark, A.predictions(spark, sf_dir), {"subset": "all", "modes": 4}, F.lit(digest)), path)
    return jsonl.read_jsonl(spark, path, "settings string, checkpoint_sha256 string, rows long")


@query("""SELECT 'question_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '_a.yaml' AS name, 'label: ' || label || chr(10) || 'kind: "item ' || (label % 3) || '"' || chr(10) AS text FROM embeddings""")
def yaml_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML files of results, by name and content."""
    folder = shared_folder(spark, "yaml")
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("item "), (F.col("label") % 3).cast("string")).alias("kind"))
    results.write_yaml_results(rows, folder, "vec_id", "_a")
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))


_JOURNAL = f"""{A.PREDICTIONS_SQL}, rounds AS (SELECT *, unnest(range(1 + (conv_id + turn) % 3)) AS round FROM predictions),
journal AS (SELECT record_id, mode, 'correctness' AS dimension, round, CASE WHEN (conv_id + mi + round) % 4 = 0 THEN 'no verdict' ELSE 'Thus **Score:** ' || (1 + (conv_id + round) % 5) END AS content FROM rounds)"""


@query(f"""WITH {_JOURNAL} SELECT record_id, mode, dimension, round, content FROM journal QUALIFY row_number() OVER (PARTITION BY record_id, mode, dimension ORDER BY round DESC) = 1 AND content <> 'no verdict'""")
def resumable_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last journal row of each task, where it states a score."""
    df = A.predictions(spark, sf_dir).withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("conv_id") + F.col("turn")) % 3).cast("long"))))
    said = F.concat(F.lit("Thus **Score:** "), (1 + (F.col("conv_id") + F.col("round")) % 5).cast("string"))
    content = F.when((F.col("conv_id") + F.col("mi") + F.col("round")) % 4 == 0, "no verdict").otherwise(said)
    journal = df.select("record_id", "mode", F.lit("correctness").alias("dimension"), "round", content.alias("content"))
    path = shared_folder(spark, "journal")
    jsonl.append_jsonl(journal, path)
    back = jsonl.read_jsonl(spark, path, "record_id string, mode string, dimension string, round long, content string")
    return resume.usable_pending(back, "round").select("record_id", "mode", "dimension", "round", "content")


@query(f"WITH {A.PREDICTIONS_SQL} SELECT record_id, mode FROM predictions WHERE mode IN ('base', 'wo_windows') AND loss >= 6")
def journal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal rows, whose record and mode are inside, that a manifest and two modes keep."""
    df = A.predictions(spark, sf_dir)
    journal = df.filter("loss >= 6").select(F.struct("record_id", "mode", "response").alias("row"), F.lit("x").alias("spec"))
    return resume.only_records(journal, df.filter("mode = 'base'").select("record_id"), ("base", "wo_windows")).select("record_id", "mode")
