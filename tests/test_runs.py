"""Run comparison, prompts, requests, numbering and named files against plain Python."""

from __future__ import annotations

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillon.functions import logprobs, prompts
from quillon.operators import compare, latest, resume, sampling
from quillon.sources import manifests, results, series
from quillon.streaming import journal

PAIRS = "record_id string, mode string, dimension string, left double, right double, delta double, changed boolean, same_prompt boolean"


def test_exact_delta_intervals(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        left, right = rng.randint(1, 5), rng.randint(1, 5)
        rows.append((f"r{i:02}", "base", "ab"[i % 2], float(left), float(right), float(right - left), i % 3 == 0, True))
    found = {r.bucket: r for r in compare.delta_intervals(spark.createDataFrame(rows, PAIRS), 200, seed=5, exact=True).collect()}
    buckets = {"overall": (rows, 5), "changed": ([r for r in rows if r[6]], 6), "unchanged": ([r for r in rows if not r[6]], 7)}
    buckets |= {f"dimension/{d}": ([r for r in rows if r[2] == d], 15 + k) for k, d in enumerate("ab")}
    assert found.keys() == buckets.keys()
    for name, (part, seed) in buckets.items():
        values = [r[5] for r in sorted(part)]
        draw = random.Random(seed)
        means = sorted(statistics.fmean(draw.choice(values) for _ in values) for _ in range(200))
        got = found[name]
        assert (got.n, got.mean, got.low, got.high) == pytest.approx((len(values), statistics.fmean(values), means[int(0.025 * 199)], means[int(0.975 * 199)]))


def test_key_mismatch_names_five_of_each_side(spark):
    a = spark.createDataFrame([(f"r{i:02}", "base") for i in range(8)], "record_id string, mode string")
    b = spark.createDataFrame([(f"r{i:02}", "base") for i in range(7, 20)], "record_id string, mode string")
    with pytest.raises(ValueError) as e:
        latest.same_keys(a, b, ["record_id", "mode"], "prediction")
    assert all(f"r{i:02}" in str(e.value) for i in [*range(5), *range(8, 13)])
    assert "r05" not in str(e.value) and "r13" not in str(e.value)
    latest.same_keys(a, a, ["record_id", "mode"], "prediction")


def test_question_types_must_agree(spark):
    rows = [("r1", "base", "a", "a"), ("r2", "base", "a", None)]
    pairs = spark.createDataFrame(rows, "record_id string, mode string, left_question_type string, right_question_type string")
    with pytest.raises(ValueError, match="r2"):
        compare.same_types(pairs)
    assert compare.same_types(pairs.limit(1)).count() == 1


def test_numbers_over_the_whole_table(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 30), i) for i in range(500)] + [(None, 500), (None, 501)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = [(r.k, r.i) for r in sorted(sampling.numbered(df, ["k", "i"], "n").collect(), key=lambda r: r.n)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.n for r in sampling.numbered(df, ["k"], "n").collect()) == list(range(502))
    assert sampling.numbered(df.limit(0), ["k"], "n").collect() == []


def test_journal_rows_are_filtered_by_their_inner_row(spark):
    inner = "row struct<record_id:string,mode:string>, record_id string"
    rows = [(("a", "base"), None), (("b", "base"), None), (None, "a"), (("a", "x"), "b")]
    manifest = spark.createDataFrame([("a",)], "record_id string")
    assert resume.only_records(spark.createDataFrame(rows, inner), manifest).count() == 3
    assert resume.only_records(spark.createDataFrame(rows, inner), manifest, ("base",)).count() == 1


def test_arguments_are_checked(spark):
    c = F.lit("x")
    for bad in ({"top_logprobs": 6}, {"top_logprobs": -1}, {"logprobs": True}):
        with pytest.raises(ValueError):
            prompts.request_body("m", c, 0.0, 1, **bad)
    for k in (0, 6):
        with pytest.raises(ValueError):
            prompts.readout_body("m", c, c, "x", 1, top_logprobs=k)
    for k, most in ((0, 0.1), (5, -0.1), (5, 1.0)):
        with pytest.raises(ValueError):
            logprobs.bounded_distribution(c, F.array(), k, most)
    assert [prompts.parse_thinking(x) for x in ("AUTO", "true", "False")] == [None, True, False]
    with pytest.raises(ValueError):
        prompts.parse_thinking("maybe")


def test_requests_are_json(spark):
    df = spark.createDataFrame([('say "hi"\n',)], "p string")
    plain = json.loads(df.select(prompts.request_body("m", F.col("p"), 0.5, 9, seed=3)).first()[0])
    assert plain == {"model": "m", "messages": [{"role": "user", "content": 'say "hi"\n'}], "temperature": 0.5, "max_tokens": 9, "seed": 3}
    more = json.loads(df.select(prompts.request_body("m", F.col("p"), 0.5, 9, True, 2, 3, True)).first()[0])
    assert more["logprobs"] is True and more["top_logprobs"] == 2 and more["enable_thinking"] is True


def test_named_files_and_the_cache(spark, tmp_path):
    rows = [(f"series_{i:06}.json", str(i), ([1.5, float(i)],), [("q", "a", None, (0, 2), None)]) for i in range(3)]
    kind = "series_file string, sample_id string, original_data struct<time_series:array<double>>, windows array<struct<question:string,answer:string,question_type:string,window_range:struct<start:int,`end`:int>,has_anomaly:boolean>>"
    folders = [f"{tmp_path}/{k}" for k in "abc"]
    for f in folders:
        assert results.write_series(spark.createDataFrame(rows, kind), f) == 3
    assert {(r.record_id, r.question_type) for r in series.load_records(spark, folders[0]).collect()} == {(f"series_{i:06}:0", "unknown") for i in range(3)}
    cache = series.SeriesCache(spark, 2)
    for f in (folders[0], folders[1], folders[0], folders[2]):
        assert cache.get(f).count() == 3
    assert cache.folders() == [folders[0], folders[2]]
    one = spark.createDataFrame([(7, 'a: "b"', None, 1.5)], "i int, text string, none string, x double")
    assert results.write_yaml_results(one, f"{tmp_path}/y", "i", "_s") == 1
    assert open(f"{tmp_path}/y/question_000007_s.yaml").read() == 'text: "a: \\"b\\""\nnone: null\nx: 1.5\n'


def test_split_manifest_and_progress(spark, tmp_path):
    names = [f"n{i}" for i in range(40)]
    (r,) = manifests.split_manifest(spark.createDataFrame([(x,) for x in names], "name string"), "name", seed=72).collect()
    order = sorted(names)
    random.Random(72).shuffle(order)
    assert (r.train_series, r.val_series) == (order[:38], order[38:])
    spark.range(10).selectExpr("cast(id as string) k", "id % 2 = 0 ok").write.json(f"{tmp_path}/in")
    rows = journal.once_by_key(journal.read_stream(spark, f"{tmp_path}/in", "k string, ok boolean"), ["k"])
    query = journal.two_sinks(rows, F.col("ok"), f"{tmp_path}/d", f"{tmp_path}/p", f"{tmp_path}/c")
    query.awaitTermination()
    told = journal.progress(query)
    assert told[-1]["processed"] == 10 and told[-1]["state"] == "done"


def test_named_files_appear_when_the_job_commits(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(40, numPartitions=4).select(F.format_string("f%02d.txt", "id").alias("name"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert results.write_named(rows, f"file://{folder}") == 40
    assert sorted(p.name for p in folder.iterdir()) == [f"f{i:02}.txt" for i in range(40)] and (folder / "f07.txt").read_text() == "text 7"
    # One task fails after others have written: no file and no staging folder is left.
    bad = rows.withColumn("name", F.when(F.col("name") == "f39.txt", F.lit("no/name")).otherwise(F.concat(F.lit("x"), "name")))
    with pytest.raises(Exception, match="not a file name"):
        results.write_named(bad, f"file://{folder}")
    assert len(list(folder.iterdir())) == 40
    assert results.write_named(rows.limit(0), f"file://{tmp_path}/none") == 0
    with pytest.raises(Exception, match="append"):
        rows.write.format("named_files").option("path", str(folder)).mode("overwrite").save()


def test_differences_of_key_sets(spark):
    import random

    from quillon.operators import reconcile

    rng = random.Random(1)
    assert all(reconcile._check(r.h) == r.c for r in spark.range(-5, 5).select(F.xxhash64("id").alias("h")).withColumn("c", F.xxhash64("h")).collect())
    keys = [(f"r{i}", rng.choice(["a", "b", None])) for i in range(3000)]
    for gone, extra, double in ((0, 0, 0), (1, 2, 0), (300, 200, 0), (5, 5, 4), (2900, 0, 0)):
        left = keys[gone:] + [(None, f"x{i}") for i in range(extra)]
        right = keys + keys[-double:] if double else keys
        frames = [spark.createDataFrame(x, "k string, m string").repartition(3) for x in (left, right)]
        want = {(*k, "left") for k in set(left) - set(right)} | {(*k, "right") for k in set(right) - set(left)}
        for cells in (reconcile.CELLS, (30,)):
            got = [tuple(r) for r in reconcile.key_difference(*frames, ["k", "m"], cells).collect()]
            assert len(got) == len(want) and set(got) == want
    a, b = spark.createDataFrame([("k", 1), ("k", 1), ("z", 1)], "k string, n int"), spark.createDataFrame([("k", 1)], "k string, n int")
    assert [tuple(r) for r in reconcile.key_difference(a, b, ["k"]).collect()] == [("z", "left")]
    table = reconcile._table(frames[0], frames[0], ["k", "m"], 100)
    assert table == {} and reconcile.decoded(table, 100) == []


def test_retries_are_state_that_a_restart_keeps(spark, tmp_path):
    from datetime import datetime, timedelta

    from quillon.streaming import retries

    hour = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    first = [("done", 1, 503), ("done", 2, 200), ("denied", 1, 401), ("late", 1, 429), ("busy", 1, 503), ("busy", 2, None), ("gone", 1, 503), ("half", 30, 429)]
    second = [("busy", 31, 500), ("late", 60, 200), ("done", 61, 401), ("half", 62, 200), ("open", 100, 503)]
    got = []
    for part in (first, second, []):
        if part:
            df = spark.createDataFrame([(k, hour(h), c) for k, h, c in part], "task string, ts timestamp, code int")
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = retries.verdicts(journal.read_stream(spark, f"{tmp_path}/in", df.schema, "parquet"), most=3, patience="48 hours")
        retries.start(rows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        out = spark.read.schema(retries.VERDICTS).parquet(f"{tmp_path}/out").collect()
        got.append(sorted((r.task, r.verdict, r.attempts, r["at"]) for r in out))
    assert [x[:3] for x in got[0]] == [("denied", "permanent", 1), ("done", "done", 2)]
    # A stream's time passes with its rows: the task that nobody tried again and the one tried too late are expired.
    assert got[1] == got[2] == sorted([
        ("denied", "permanent", 1, hour(1)), ("done", "done", 2, hour(2)), ("busy", "exhausted", 3, hour(31)),
        ("late", "expired", 1, hour(49)), ("gone", "expired", 1, hour(49)), ("half", "done", 2, hour(62)),
    ])
    assert spark.conf.get(retries._STORE).endswith("HDFSBackedStateStoreProvider")


def test_splits_of_more_names_than_their_sql_can_shuffle(spark):
    """The SQL makes 624 words of the generator and has no rows beyond; Python's shuffle tells what is right."""
    import duckdb

    from quillon import registry

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert con.sql(f"SELECT count(*) FROM ({registry.ORACLE_SQL['split_manifest']})").fetchall() == [(0,)]
    order = [f"series_{u:06}.json" for u in range(1500)]
    random.Random(72).shuffle(order)
    got = sorted((r.split, r.place, r.series_file) for r in registry.QUERIES["split_manifest"](spark, sf).collect())
    assert got == [("train", i, x) for i, x in enumerate(order[:1425])] + [("val", i, x) for i, x in enumerate(order[1425:])]


def test_retries_keep_the_tasks_of_a_bucket_apart(spark, tmp_path):
    """State is asked for once a bucket, not once a task; verdicts don't depend on the number of buckets."""
    from quillon.streaming import retries

    rng = random.Random(2)
    rows = [(f"t{rng.randrange(60)}", 1_700_000_000_000_000 + 1_000_000 * i * 3600, rng.choice([200, 401, 429, 503, None])) for i in range(400)]
    expected = {}
    for task in {r[0] for r in rows}:
        n, due = 0, None
        for _, at, code in [r for r in rows if r[0] == task] + [(task, rows[-1][1] + 1, "end")]:
            late = due is not None and (at > due or code == "end" and due <= rows[-1][1])
            n, due = (n, due) if late or code == "end" else (n + 1, at + 48 * 3_600_000_000)
            verdict = "expired" if late else None if code == "end" else retries.outcome(code, n, 3)
            if verdict:
                expected[task] = (verdict, n)
                break
    df = spark.createDataFrame(rows, "task string, us long, code int").selectExpr("task", "timestamp_micros(us) AS ts", "code")
    for buckets in (1, 7):
        for k, part in enumerate((df.filter(f"unix_micros(ts) < {rows[200][1]}"), df.filter(f"unix_micros(ts) >= {rows[200][1]}"))):
            part.write.mode("append").parquet(f"{tmp_path}/{buckets}/in")
            stream = retries.verdicts(journal.read_stream(spark, f"{tmp_path}/{buckets}/in", df.schema, "parquet"), most=3, buckets=buckets)
            retries.start(stream, f"{tmp_path}/{buckets}/out", f"{tmp_path}/{buckets}/state").awaitTermination()
        got = spark.read.schema(retries.VERDICTS).parquet(f"{tmp_path}/{buckets}/out").collect()
        assert {r.task: (r.verdict, r.attempts) for r in got} == expected and len(got) == len(expected)


def test_the_one_task_of_a_streamed_file_only_copies_rows(spark, monkeypatch):
    """What a file is made of is sorted before, by many tasks: their sorts would all be held by the one that writes it."""
    from quillon import registry
    from quillon.sources import jsonl

    plans, append = [], jsonl.append_jsonl
    monkeypatch.setattr(jsonl, "append_jsonl", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), append(df, path)))
    assert registry.QUERIES["stream_progress"](spark, "/root/testdata/sf0.001").first().files == 4
    assert len(plans) == 4 and not any("Window" in p or "Sort" in p for p in plans)


def test_series_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Spark's own file sources would hold each file's status on the driver, once for every scan."""
    body = lambda k: json.dumps({"sample_id": str(k), "original_data": {"time_series": [0.5, k]}, "windows": [{}]})
    rows = spark.range(300).select(F.format_string("series_%06d.json", "id").alias("series_file"), F.col("id").cast("string").alias("sample_id"), F.expr("struct(array(0.5D, double(id)) AS time_series)").alias("original_data"), F.expr("array(struct('q' AS question))").alias("windows"))
    dealt, flat = f"{tmp_path}/dealt", tmp_path / "flat"
    assert results.write_series(rows, dealt, spread=True) == 300
    flat.mkdir()
    for k in range(300):
        (flat / f"series_{k:06}.json").write_text(body(k))
    (flat / "other.json").write_text("{broken")
    (flat / "inner").mkdir()
    (flat / "inner" / "series_999999.json").write_text(body(9))
    order = [f"series_{k:06}.json" for k in range(300)]
    random.Random(42).shuffle(order)
    for folder in (dealt, str(flat), f"file://{flat}/"):
        for split, names in (("train", order[:285]), ("val", order[285:])):
            df = series.load_split(spark, folder, split)
            assert not [f for f in df.inputFiles() if "series_0" in f]
            assert sorted((r.series_file, r.sample_id, r.original_data.time_series[1]) for r in df.collect()) == sorted((x, str(int(x[7:13])), float(x[7:13])) for x in names)
        short = series.load_records(spark, folder, "paper140")
        assert not [f for f in short.inputFiles() if "series_0" in f]
        assert [r.series_file for r in sorted(short.collect(), key=lambda r: r.series_index)] == order[6:76]
    with pytest.raises(Exception, match="(?i)malformed"):
        (flat / "series_000300.json").write_text('{"sample_id": ')
        series.read_series(spark, str(flat)).collect()
    with pytest.raises(Exception, match="no series"):
        (tmp_path / "none").mkdir()
        series.list_names(spark, f"{tmp_path}/none")


def test_dealt_files_are_moved_by_subfolder(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from quillon.sources import named_files

    folder, moved = tmp_path / "out", []
    writers = [named_files.NamedFilesWriter(str(folder), spread=True) for _ in range(2)]
    told = [w.write(iter([{"name": f"f{k}.txt", "text": f"{t} {k}"} for k in range(2000 * t, 2000 * t + 3000)])) for t, w in enumerate(writers)]  # names 2000 to 2999 in both
    store = fs.LocalFileSystem()
    monkeypatch.setattr(named_files, "_store", lambda f: (type("Told", (), {"__getattr__": lambda s, n: getattr(store, n), "move": lambda s, a, b: (moved.append(b), store.move(a, b))})(), f))
    writers[0].commit([told[0], None])
    assert len(moved) == named_files.SPREAD
    writers[1].commit([told[1]])
    monkeypatch.undo()
    files = {p.name: p for p in folder.rglob("*.txt")}
    assert len(list(folder.rglob("*.txt"))) == len(files) == 5000 and files["f10.txt"].read_text() == "0 10" and files["f2500.txt"].read_text() == "1 2500"
    rows = named_files.listed(spark, str(folder)).collect()
    assert {r.name for r in rows} == set(files) and len(rows) == 5000
    (folder / "f10.txt").write_text("flat")
    (r,) = named_files.texts(named_files.listed(spark, str(folder)).filter("name = 'f10.txt'")).collect()
    assert tuple(r) == ("f10.txt", "0 10")
    found = spark.createDataFrame([(p.name, p.parent.name) for p in files.values()], "name string, part string")
    assert found.filter(F.format_string("named-%02x", named_files.part("name")) != F.col("part")).count() == 0


def test_series_in_a_store_that_only_spark_reads(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"series_{k:06}.json").write_text(json.dumps({"sample_id": str(k), "original_data": {"time_series": [0.5, k]}, "windows": [{}]}))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.series.link./in", f"file://{tmp_path}")
    for split in ("train", "val"):
        rows = [sorted((r.series_file, r.sample_id) for r in series.load_split(spark, folder, split).collect()) for folder in (str(tmp_path), "viewfs://series/in")]
        assert rows[0] == rows[1] and len(rows[0]) == {"train": 19, "val": 1}[split]
    assert series.load_records(spark, "viewfs://series/in", max_records=7).count() == 7
