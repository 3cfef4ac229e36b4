"""Every registered query against its SQL, and those without SQL against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from quillon import registry
from quillon.functions import text as T
from quillon.operators import bootstrap, generator
from quillon.operators import draws as D

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def _tokens(t: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9.+\-/%]+", t.lower())


def _lcs(a, b):
    """By trying all subsequences of the shorter list, longest first."""
    from itertools import combinations

    a, b = sorted((a, b), key=len)

    def inside(picked):
        rest = iter(b)
        return all(t in rest for t in picked)

    return next(n for n in range(len(a), -1, -1) if any(map(inside, combinations(a, n))))


def test_rouge_and_token_f1_against_python(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "1.5", "x-y", "50%", "É", "!"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(60)]
    pairs += [("", ""), ("a", ""), ("", "a"), (None, "a"), ("a a a", "a a")]
    df = spark.createDataFrame(pairs, "p string, r string")
    for row in df.select("p", "r", T.token_f1(F.col("p"), F.col("r")).alias("f"), T.rouge_l_f1(F.col("p"), F.col("r")).alias("l")).collect():
        p, r = _tokens(row.p or ""), _tokens(row.r or "")
        for value, common in ((row.f, sum((Counter(p) & Counter(r)).values())), (row.l, _lcs(p, r))):
            expected = 1.0 if not p and not r else 0.0 if not common else 2 * common / (len(p) + len(r))
            assert value == pytest.approx(expected)


def drawn(values: list[float], samples: int, seed: int, pick: str = "randrange") -> list[float]:
    """Sorted means of resamples by Python's generator."""
    rng = random.Random(seed)
    draw = (lambda: values[rng.randrange(len(values))]) if pick == "randrange" else (lambda: rng.choice(values))
    return sorted(sum(draw() for _ in values) / len(values) for _ in range(samples))


@pytest.mark.parametrize("block", [64, bootstrap.BLOCK])
def test_exact_bootstrap_is_that_of_the_generator(spark, block):
    rng = random.Random(1)
    rows = [(m, f"r{i}", rng.gauss(0, 1)) for m, n in (("a", 30), ("b", 64), ("one", 1), (None, 17)) for i in range(n)]
    rows += [("a", "x", None), ("none", "x", None), ("a", "y", float("nan"))]
    df = spark.createDataFrame(rows, "mode string, record_id string, diff double")
    out = bootstrap.exact_intervals(df.repartition(3), "mode", "diff", ["record_id"], samples=100, seeds={"b": 9}, block=block)
    got = {r["mode"]: r for r in out.collect()}
    assert set(got) == {"a", "b", "one", None}
    for m, r in got.items():
        values = [v for g, _, v in sorted((x for x in rows if x[0] == m and x[2] is not None and x[2] == x[2]), key=lambda x: x[1])]
        means = drawn(values, 100, 9 if m == "b" else 72, "choice" if m == "b" else "randrange")
        assert r.n == len(values) and (r["mean"], r.low, r.high) == pytest.approx((sum(values) / len(values), means[2], means[97]))
    assert bootstrap.exact_intervals(df.limit(0), "mode", "diff", ["record_id"], samples=10).count() == 0


def test_exact_draws_of_one_group_come_from_many_tasks(spark):
    of = spark.createDataFrame([("=g", 700)], "_k string, n long")
    draws = bootstrap.generator_draws(of, 40, 72, block=1024)
    assert len(draws.select(F.spark_partition_id().alias('p')).distinct().collect()) >= 2
    got = [r["_i"] for r in draws.orderBy("_b").groupBy("_b").agg(F.sort_array(F.collect_list("_i")).alias("_i")).orderBy("_b").collect()]
    rng = random.Random(72)
    assert got == [sorted(rng.randrange(700) for _ in range(700)) for _ in range(40)]


@pytest.mark.parametrize("block", [256, 1024, 1 << 14])
def test_exact_rounds_are_sent_whole(spark, block):
    of = spark.createDataFrame([("=g", 700), ("=h", 1)], "_k string, n long")
    rows = bootstrap.packed_generator_draws(of, 40, 72, block=block).collect()
    assert Counter((r["_k"], r["_b"]) for r in rows) == Counter((k, b) for k in ("=g", "=h") for b in range(40))  # one row each, whatever the blocks
    rng, values = random.Random(72), np.arange(700.0)
    expected = [sum(rng.randrange(700) for _ in range(700)) for _ in range(40)]
    assert [D.weighted(r["_counted"], r["_data"], values) for r in sorted(rows, key=lambda r: r["_b"]) if r["_k"] == "=g"] == expected


def test_rounds_beyond_a_piece_are_sent_in_pieces():
    first = generator.stream(72).state["state"]
    row = {"_k": "=g", "n": 700, "_block": 0, "_key": first["key"].tobytes(), "_pos": first["pos"], "_before": 0, "_first": 0, "_end": 3}
    pieces = [(b, places.tolist()) for _, _, b, places in bootstrap._rounds([pa.RecordBatch.from_pylist([row])], most=300)]
    rng = random.Random(72)
    assert [(b, len(p)) for b, p in pieces] == [(b, m) for b in range(3) for m in (300, 300, 100)]
    assert [x for _, p in pieces for x in p] == [rng.randrange(700) for _ in range(2100)]


def test_draws_of_a_large_round_take_half_a_byte():
    n = 3 << 20  # packed by 2 ** 21 draws, the places took a byte each
    rows = [{"_k": "=g", "n": n, "_b": 0, "_from": a} for a in range(0, n, D.CHUNK)]
    sent = list(bootstrap._hash(72)([pa.RecordBatch.from_pylist(rows)]))
    assert sum(len(x) for batch in sent for x in batch.column("_data").to_pylist()) <= 0.55 * n


@pytest.mark.parametrize("intervals", [bootstrap.hashed_intervals, bootstrap.split_intervals])
def test_bootstrap_has_the_width_of_independent_resamples(spark, intervals):
    rng = random.Random(3)
    rows = [(f"m{n}", i, rng.gauss(0, 1)) for n in (400, 1000, 3000) for i in range(n)]
    rows += [("coin", i, float(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "mode string, record_id long, diff double")
    more = {"order": ["record_id"]} if intervals is bootstrap.hashed_intervals else {}
    for r in intervals(df, "mode", "diff", samples=1000, **more).collect():
        values = [v for m, _, v in rows if m == r.mode]
        mean = sum(values) / r.n
        error = (sum((v - mean) ** 2 for v in values) / r.n / r.n) ** 0.5
        assert r.mean == pytest.approx(mean)
        assert (r.high - r.low) / (2 * 1.96 * error) == pytest.approx(1, abs=0.12)
        assert abs((r.high + r.low) / 2 - mean) < 0.3 * error


def test_split_bootstrap_is_one_multinomial_whatever_the_partitions(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(333)]
    rows = [("g", v) for v in values] + [("one", 2.0), (None, 3.0), ("g", None), ("g", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "mode string, diff double")
    got = [{r["mode"]: tuple(r) for r in bootstrap.split_intervals(df.repartition(k), "mode", "diff", samples=700).collect()} for k in (1, 5)]
    assert set(got[0]) == set(got[1]) == {"g", "one", None} and got[0]["one"][2:] == (2.0, 2.0, 2.0)
    tree, means = bootstrap.Splits(72, "=g", 333, 700), 0
    tally = sorted(Counter(values).items())
    at, total = 0, 0
    for v, m in tally:
        weight = tree.below(at + m) - bootstrap.Splits(72, "=g", 333, 700).below(at)
        assert (weight >= 0).all()
        at, total, means = at + m, total + weight, means + v * weight
    assert (total == 333).all()
    means = sorted(means / 333)
    for g in got:
        assert g["g"][1:] == pytest.approx((333, sum(values) / 333, means[17], means[682]))
    assert bootstrap.split_intervals(df.limit(0), "mode", "diff", samples=10).count() == 0


def test_medians_by_selection(spark):
    import statistics

    from quillon.operators import selection

    rng = random.Random(2)
    pool = [0.0, -0.0, 1e-300, -1e300, 5e-324, float("inf"), -float("inf"), 3.5, 3.5000000000000004]
    rows = [(g, rng.choice(pool) if rng.random() < 0.5 else rng.gauss(0, 10 ** rng.randint(-5, 5))) for g, n in (("odd", 501), ("even", 400), (None, 7)) for _ in range(n)]
    rows += [("same", 2.0)] * 1000 + [("one", -1.5), ("none", None), ("odd", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r["median"] for r in selection.exact_medians(df, "g", "v").collect()}
    want = {g: statistics.median([v for k, v in rows if k == g and v is not None]) for g in ("odd", "even", "same", "one", None)}
    assert got == want
    assert selection.exact_medians(df, None, "v").first()["median"] == statistics.median(v for _, v in rows if v is not None)
    assert selection.exact_medians(df.limit(0), "g", "v").count() == 0
    plan = selection.exact_medians(df, "g", "v")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan


def test_both_index_rules():
    assert bootstrap.interval_indices(1000) == (25, 975)
    assert bootstrap.interval_indices(1000, closed=True) == (24, 974)


def test_rows_only_queries_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, SF).count() > 0, name


def test_hashed_draws_are_made_in_arrays_and_sent_packed(spark):
    from quillon.operators import draws

    groups = [("a", 3, 0, 1200, 999), (None, 12, 0, 1100, 77), ("é" * 40, 0, 99_990, 101_500, 123_456_789_012), ("x" * 50, 499, 9_000, 10_500, 1 << 59)]
    for g, b, start, stop, n in groups:
        i = spark.range(start, stop).select(F.lit(g).cast("string").alias("g"), F.lit(b).alias("b"), "id", F.lit(n).cast("long").alias("n"))
        told = [r[0] for r in i.select(bootstrap.hashed_draw(F.col("g"), F.col("b"), F.col("id"), F.col("n"), 72)).collect()]
        assert draws.hashed_places(72, g, b, start, stop, n).tolist() == told
    places = random.Random(4).choices(range(150_001), k=90_000) + [7] * 400 + random.Random(5).choices(range(70_000), k=60_000)
    values = bootstrap.np.random.default_rng(1).normal(size=150_001)
    rows = list(draws.packed(bootstrap.np.array(places), len(values)))
    assert {counted for _, counted, _ in rows} == {True, False} and sum(len(d) for *_, d in rows) < 2 * len(places)
    got = sum(D.weighted(counted, d, values[p * draws.PART : (p + 1) * draws.PART]) for p, counted, d in rows)
    assert got == pytest.approx(float(values[places].sum()))
    assert D.weighted(True, bytes([0x10]), bootstrap.np.array([float("inf"), 2.0])) == 2.0


@pytest.mark.parametrize("intervals", [bootstrap.hashed_intervals, bootstrap.exact_intervals])
def test_no_row_a_draw_passes_a_join_or_broadcast(spark, intervals, capsys):
    df = spark.range(200).selectExpr("'g' AS mode", "id AS record_id", "CAST(id AS DOUBLE) AS diff")
    intervals(df, "mode", "diff", ["record_id"], samples=300).explain()
    plan = capsys.readouterr().out
    # Draws are made in Arrow and weighed in Arrow; between both they are only dealt and sorted.
    weigh, make = plan.index("_weigh"), plan.index("draw(")
    assert weigh < make and "Join" not in plan[weigh:make]


@pytest.mark.parametrize("kind", ["exact", "hashed"])
def test_groups_of_several_parts(spark, kind):
    from quillon.operators import draws

    n, samples = draws.PART + 4_000, 12
    df = spark.range(n).selectExpr("'g' AS mode", "id AS record_id", "CAST(id % 1013 AS DOUBLE) AS diff")
    (r,) = getattr(bootstrap, f"{kind}_intervals")(df, "mode", "diff", ["record_id"], samples=samples).collect()
    rng, values = random.Random(72), bootstrap.np.arange(n) % 1013
    one = {"exact": lambda b: [rng.randrange(n) for _ in range(n)], "hashed": lambda b: draws.hashed_places(72, "g", b, 0, n, n)}[kind]
    means = sorted(float(values[one(b)].mean()) for b in range(samples))
    assert (r.n, r["mean"], r.low, r.high) == pytest.approx((n, float(values.mean()), means[0], means[11]))
