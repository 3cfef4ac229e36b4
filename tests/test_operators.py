"""Tables, comparison, audits, judging, sources and streams on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillon import schemas
from quillon.operators import audit, compare, judging, latest, resume, sampling, selection, tables
from quillon.sources import jsonl, manifests, series
from quillon.streaming import journal

SCORES = "record_id string, mode string, question_type string, dimension string, weight double, score double"


def test_weighted_table_needs_complete_records(spark):
    rows = [("a", "base", "multiple_choice", "correctness", 0.7, 5.0), ("a", "base", "multiple_choice", "reasoning_quality", 0.3, 3.0),
            ("b", "base", "multiple_choice", "correctness", 0.7, 1.0), ("c", "base", "unknown", "x", 1.0, 1.0)]
    got = {r.metric: r.value for r in tables.weighted_table(spark.createDataFrame(rows, SCORES)).collect()}
    assert got["multiple_choice/final"] == pytest.approx(4.4) and got["macro_final"] == pytest.approx(4.4)
    assert tables.weighted_table(spark.createDataFrame([], SCORES)).count() == 0


def test_last_score_wins(spark):
    rows = [("a", "base", "multiple_choice", "correctness", 0.7, 1.0, 1), ("a", "base", "multiple_choice", "correctness", 0.7, 5.0, 2),
            ("a", "base", "multiple_choice", "reasoning_quality", 0.3, 3.0, 3)]
    assert tables.record_finals(spark.createDataFrame(rows, SCORES + ", _line_no long")).first().final == pytest.approx(4.4)


def test_compare_runs(spark):
    p = "record_id string, mode string, response string"
    s = "record_id string, mode string, dimension string, score double, prompt_sha256 string"
    left_p = spark.createDataFrame([("a", "base", "same"), ("b", "base", "old")], p)
    right_p = spark.createDataFrame([("a", "base", "same"), ("b", "base", "new")], p)
    left = spark.createDataFrame([("a", "base", "d", 3.0, "x"), ("b", "base", "d", 2.0, "y")], s)
    right = spark.createDataFrame([("a", "base", "d", 4.0, "x"), ("b", "base", "d", 5.0, "z")], s)
    got = {r.bucket: r for r in compare.summarize_scores(compare.score_pairs(left, right, left_p, right_p)).collect()}
    assert (got["overall"].n, got["changed"].n, got["unchanged"].n) == (2, 1, 1)
    assert got["changed"].delta_mean == 3.0 and got["overall"].unchanged_same_prompt == 1
    with pytest.raises(ValueError, match="key mismatch"):
        latest.same_keys(left, right.filter("record_id = 'a'"), ["record_id"], "score")
    with pytest.raises(ValueError, match="duplicate"):
        latest.fail_on_duplicates(left.union(left), ["record_id"], "score")


def test_audit_reports_and_fails_closed(spark):
    predictions = spark.createDataFrame([("a", "base", "true_false", "ok"), ("a", "base", "true_false", " ")], "record_id string, mode string, question_type string, response string")
    report = {r.check: r.bad for r in audit.audit_predictions(predictions, modes=("base", "wo_windows")).collect()}
    assert report == {"duplicate_keys": 1, "empty_response": 1, "unexpected": 0, "missing": 1}
    with pytest.raises(ValueError, match="empty_response"):
        audit.fail_closed(audit.audit_predictions(predictions, modes=("base",)))


def test_score_checks(spark):
    schema = "record_id string, mode string, dimension string, score string, method string, fallback_scores array<int>, logprobs_returned boolean, distribution map<string,double>, missing_score_mass_upper_bound double, prompt_sha256 string, _line_no int"
    fine = {str(i): 0.2 for i in range(1, 6)}
    rows = [("a", "base", "d", "4.5", "exact_sample_mean_20", [4] * 20, True, fine, 1e-7, "0" * 64, 1), ("b", "base", "d", "x", "m", None, True, fine, 1e-7, "0" * 64, 2),
            ("c", "base", "d", "6", "exact_sample_mean_5", [1] * 5, False, None, 1e-3, "zz", 3)]
    df = spark.createDataFrame(rows, schema)
    checks = audit.score_checks(most_missing=1e-6, need_logprobs=True, need_hashes=True)
    got = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items())).first().asDict()
    assert got == {"score_not_numeric": 1, "score_out_of_range": 1, "samples": 1, "logprobs": 1, "missing_mass": 1, "prompt_hash": 1}
    assert audit.first_bad_row(df).first().check == "score_not_numeric"


def test_selection(spark):
    df = spark.createDataFrame([("e1", "t", 2.0), ("e1", "t", 4.0), ("e2", "t", 3.0), ("e3", "t", 9.0)], "candidate string, question_type string, loss double")
    summary = selection.loss_summary(df, "candidate")
    assert selection.best_candidate(summary, "candidate").first().candidate == "e1"
    with pytest.raises(Exception, match="without loss"):
        selection.loss_summary(df.withColumn("loss", F.lit(None).cast("double")), "candidate").collect()


def shuffle(n: int, seed: int) -> list[int]:
    import random

    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("n, seed, block", [(0, 1, 8), (1, 1, 8), (2, 1, 8), (3, 72, 8), (700, 42, 64), (1025, 7, 1 << 20)])
def test_permutation_is_the_seeded_shuffle(spark, n, seed, block):
    got = {r.position: r.source for r in sampling.permutation(spark, n, seed, block).collect()}
    assert [got[i] for i in range(n)] == shuffle(n, seed) and len(got) == n


def test_shuffle_of_very_many_names(spark):
    n = 100_000
    names = spark.range(n).select(F.format_string("series_%06d.json", "id").alias("name")).repartition(7)
    order = sampling.shuffled(names, "name", 42, block=9000)
    wrong = spark.createDataFrame(list(enumerate(shuffle(n, 42))), "position long, source long").join(order, "position").filter(F.col("name") != F.format_string("series_%06d.json", "source"))
    assert order.count() == n and wrong.count() == 0


def test_sampling_order(spark):
    names = [f"series_{i:06d}.json" for i in range(100)]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "name string")
    order = [names[k] for k in shuffle(100, 42)]
    split = sampling.split_names(df, "name").orderBy("position").collect()
    assert [r["name"] for r in split] == order and [r.split for r in split] == ["train"] * 95 + ["val"] * 5
    assert [r["name"] for r in sampling.short_subset(df, "name").orderBy("position").collect()] == order[2:72]


def test_resume(spark):
    predictions = spark.createDataFrame([("a", "base", "true_false")], "record_id string, mode string, question_type string")
    done = spark.createDataFrame([("a", "base", "correctness")], "record_id string, mode string, dimension string")
    assert [r.dimension for r in resume.remaining(resume.judge_tasks(predictions), done).collect()] == ["justification_quality"]
    with pytest.raises(Exception, match="unknown question type"):
        resume.judge_tasks(predictions.withColumn("question_type", F.lit("odd"))).collect()
    log = spark.createDataFrame([("a", "base", "d", "Score: 4", 1), ("a", "base", "d", "none", 2)], "record_id string, mode string, dimension string, content string, _line_no int")
    assert resume.usable_pending(log).count() == 0


def test_remaining_tasks_through_the_filter(spark, monkeypatch):
    tasks = [(f"r{i % 900}", "base", "d", i) for i in range(1000)] + [(None, "base", "d", -1), ("r1", None, "d", -2)]
    done = [(f"r{i}", "base", "d") for i in range(0, 900, 3)] * 2 + [(None, "base", "d"), ("other", "base", "d")]
    a = spark.createDataFrame(tasks, "record_id string, mode string, dimension string, n long").repartition(3)
    b = spark.createDataFrame(done, "record_id string, mode string, dimension string")
    want = sorted(t[3] for t in tasks if t[:3] not in set(done) or None in t[:3])
    plain = sorted(r.n for r in a.join(b, resume.TASK, "left_anti").collect())
    assert want == plain
    for most in (resume.MOST_BITS, 64):
        monkeypatch.setattr(resume, "MOST_BITS", most)
        got = resume.remaining(a, b)
        assert sorted(r.n for r in got.collect()) == want and got.columns == a.columns
    monkeypatch.undo()
    assert resume.remaining(a, b.limit(0)).count() == len(tasks) and resume.remaining(a.limit(0), b).count() == 0
    row, bits = resume.done_filter(b.dropna(), resume.TASK)
    assert bits == 64 * -(-601 * 12 // 64) and len(row.first().words) * 64 == bits
    fresh = spark.range(20_000).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("record_id"), F.lit("base").alias("mode"), F.lit("d").alias("dimension"))
    passed = fresh.filter(resume.maybe_done(resume.TASK, row.scalar(), bits)).count()
    assert passed < 0.02 * 20_000 and b.dropna().filter(resume.maybe_done(resume.TASK, row.scalar(), bits)).count() == 601


def test_judging_verdicts(spark):
    def client(prompt, attempt):
        if prompt == "denied":
            raise judging.JudgeError(401)
        if prompt == "busy" and attempt == 1 or prompt == "down":
            raise judging.JudgeError(503)
        return {"choices": [{"message": {"content": "Score: 4"}}]}

    tasks = spark.createDataFrame([(p, "base", "d", p) for p in ("fine", "denied", "busy", "down")], "record_id string, mode string, dimension string, prompt string")
    got = {r.record_id: (r.verdict, r.attempts) for r in judging.judge(tasks, client, max_rounds=2, sleep=lambda s: None).collect()}
    assert got == {"fine": ("done", 1), "denied": ("permanent", 1), "busy": ("done", 2), "down": ("exhausted", 2)}
    sampled = judging.sample_scores(tasks.filter("record_id = 'fine'"), client).first()
    assert sampled.fallback_scores == [4] * 20 and sampled.score == 4.0
    assert judging.wait_seconds(9) == 32.0


def test_jsonl_round_trip_and_strictness(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("é", None), ("b", 1.5)], "record_id string, loss double")
    jsonl.write_jsonl(df, path)
    jsonl.append_jsonl(df, path)
    assert jsonl.read_jsonl(spark, path, "record_id string, loss double").count() == 4
    (tmp_path / "bad.json").write_text('{"record_id": "a"}\n\n{broken\n')
    with pytest.raises(Exception, match=r"(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.json"), "record_id string").collect()


def test_series_files(spark, tmp_path):
    for i in range(3):
        window = {"question": "q", "answer": "a", "question_type": "true_false", "window_range": {"start": 1, "end": 3}, "has_anomaly": True}
        (tmp_path / f"series_{i:06d}.json").write_text(json.dumps({"sample_id": i, "original_data": {"time_series": [0.5, 1.0]}, "windows": [window, {}]}))
    rows = series.load_records(spark, str(tmp_path))
    assert sorted(r.record_id for r in rows.collect()) == [f"series_{i:06d}:{k}" for i in range(3) for k in range(2)]
    assert series.load_records(spark, str(tmp_path), max_records=4).count() == 4
    manifest = manifests.subset_manifest(rows, "full").first()
    assert manifest.record_count == 6 and manifest.record_ids[0] == "series_000000:0"
    manifests.write_json(manifests.subset_manifest(rows, "full"), str(tmp_path / "m"))
    assert manifests.read_ids(spark, str(tmp_path / "m")).count() == 6
    assert series.load_split(spark, str(tmp_path), "val").count() + series.load_split(spark, str(tmp_path), "train").count() == 3
    with pytest.raises(ValueError):
        series.load_records(spark, str(tmp_path), "odd")
    assert manifests.file_digests(spark, str(tmp_path / "series_000000.json")).first().length > 0


def test_schemas_parse(spark):
    for ddl in (schemas.SERIES_FILE, schemas.PREDICTION, schemas.SCORE, schemas.RESPONSE, schemas.JOURNAL, schemas.SUBSET, schemas.SPLIT):
        assert spark.createDataFrame([], ddl).count() == 0


def test_stream_splits_once(spark, tmp_path):
    source, rows = tmp_path / "in", [{"record_id": "a", "n": 1}, {"record_id": "a", "n": 1}, {"record_id": "b", "n": None}]
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    where = [str(tmp_path / x) for x in ("done", "pending", "checkpoint")]
    for _ in range(2):  # the second start has nothing left to do
        stream = journal.once_by_key(journal.read_stream(spark, str(source), "record_id string, n int"), ["record_id"])
        journal.two_sinks(stream, F.col("n").isNotNull(), *where).awaitTermination(120)
    assert [r.record_id for r in spark.read.json(where[0]).collect()] == ["a"]
    assert [r.record_id for r in spark.read.json(where[1]).collect()] == ["b"]


def test_markdown(spark):
    from quillon.operators.tables import RUBRIC

    metrics = sorted({f"{k}/{p}" for k, d, _ in RUBRIC for p in (d, "final")})
    rows = [(m, c, 4.0 + (m == "base")) for m in ("odd", "wo_windows", "base") for c in [*metrics, "macro_final"]]
    table = spark.createDataFrame(rows, "mode string, metric string, value double")
    intervals = spark.createDataFrame([("wo_windows", -1.0, -1.25, -0.5)], "mode string, mean double, low double, high double")
    lines = manifests.markdown_table(table, intervals).splitlines()
    assert lines[0] == (
        "| mode | multiple_choice final | multiple_choice correctness | multiple_choice reasoning_quality | open_ended final | open_ended accuracy"
        " | open_ended completeness | open_ended relevance | true_false final | true_false correctness | true_false justification_quality |"
    )
    assert lines[2] == "| base |" + " 5.00 |" * 10 and [x.split()[1] for x in lines[2:5]] == ["base", "wo_windows", "odd"]
    assert lines[5:] == ["", "Mean difference to base, 95% bootstrap interval:", "- wo_windows: -1.000 [-1.250, -0.500]"]
    assert manifests.markdown_table(table.filter("metric <> 'open_ended/accuracy'")) == ""


def test_batches_are_padded_to_their_own_longest(spark):
    from quillon.operators import batches

    sizes = {"a": 5, "b": 1, "c": 9, "d": 2, "e": 40}
    points = spark.createDataFrame([(k, i, float(i + 1)) for k, n in sizes.items() for i in range(n)], "series string, pos long, value double").repartition(3)
    batch = batches.by_length(points.groupBy("series").agg(F.count("*").alias("n")), "series", "n", 2)
    assert {r.series: (r.batch, r.longest) for r in batch.collect()} == {"e": (0, 40), "c": (0, 40), "a": (1, 5), "d": (1, 5), "b": (2, 1)}
    rows = batches.padded_patches(points, batch, "series", 4).orderBy("series", "patch").collect()
    for k, n in sizes.items():
        longest = {"e": 40, "c": 40, "a": 5, "d": 5, "b": 1}[k]
        own = [r for r in rows if r.series == k]
        assert sum((r["values"] for r in own), []) == [float(i + 1) for i in range(n)] + [0.0] * (longest - n)
        assert sum((r["mask"] for r in own), []) == [True] * n + [False] * (longest - n)
    assert batches.padded_patches(points.limit(0), batch.limit(0), "series", 4).count() == 0
