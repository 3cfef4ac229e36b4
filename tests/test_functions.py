"""Fixed cases of the scalar functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, logprobs
from quillon.functions import text as T

TOKENS = "array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [("B", "B"), ("c) because", "C"), ("The correct option is B.", "B"), ("The answer is a spike", "A"), ("D is correct, not option", "D"),
     ("a very long text that names nothing at all", None), ("", None), (None, None), (" x B", "B"), ("choice: d", "D")],
)
def test_choice(spark, text, expected):
    assert one(spark, T.extract_choice(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("True", True), ("not true", True), ("yes, but false", True), ("No. True", False), ("The statement is FALSE.", False), ("maybe", None), (None, None), ("answer: false", False)],
)
def test_verdict(spark, text, expected):
    assert one(spark, T.extract_true_false(F.lit(text).cast("string"))) is expected


def test_numbers_compare_as_written(spark):
    assert one(spark, T.numeric_f1(F.lit("1 and 2"), F.lit("1.0 and 2"))) == 0.5
    assert one(spark, T.numeric_f1(F.lit("none"), F.lit("none"))) is None
    assert one(spark, T.numeric_f1(F.lit("1"), F.lit("none"))) == 0.0


def test_score_and_types(spark):
    assert one(spark, T.score_from_text(F.lit("Score: 5 no, **Score:** [3]"))) == 3
    assert one(spark, T.score_from_text(F.lit("no verdict"))) is None
    assert one(spark, T.normalize_type(F.lit("Multiple-Choice!"))) == "multiple_choice"
    assert one(spark, T.normalize_type(F.lit("TrueFalse"))) == "true_false"
    assert one(spark, T.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, T.endpoint_host(F.lit("https://h.example:8/v1"))) == "h.example:8"
    assert one(spark, T.safe_name(F.lit("a/b c.d"))) == "a_b_c.d"


def respond(spark, content, tokens):
    return spark.createDataFrame([(content, tokens)], f"content string, tokens {TOKENS}")


def alts(*pairs):
    return [(t, float(v)) for t, v in pairs]


def test_final_score_ignores_reasoning_digits(spark):
    peak1 = alts(*((d, 0.0 if d == "1" else -20.0) for d in "12345"))
    peak5 = alts(*((d, 0.0 if d == "5" else -20.0) for d in "12345"))
    df = respond(spark, "Reasoning 5 and 4. **Score:** 1", [("Reasoning 5 and 4. ", 0.0, peak5), ("**Score:** ", 0.0, []), ("1", 0.0, peak1)])
    p = logprobs.final_distribution(F.col("content"), F.col("tokens"))
    assert df.select(logprobs.expectation(p).alias("s")).first().s < 1.01
    assert df.select(logprobs.expectation(logprobs.fullest_distribution(F.col("tokens"))).alias("s")).first().s > 4.99


def test_bounded_score_accepts_and_rejects(spark):
    five = alts(("4", -3e-6), ("3", -13.25), ("5", -13.5), ("?", -21.375), ("2", -24.5625))
    df = respond(spark, "**Score:** 4", [("**Score:** ", 0.0, []), ("4", -3e-6, five)])
    b = df.select(logprobs.bounded_distribution(F.col("content"), F.col("tokens")).alias("b")).first().b
    assert b.missing == 1 and b.missing_mass_bound < 1e-6 and 3.99 < b.score <= 4.01
    flat = alts(*(("12?45"[i], -0.1 * i) for i in range(5)))
    df = respond(spark, "**Score:** 4", [("**Score:** ", 0.0, []), ("4", 0.0, flat)])
    assert df.select(logprobs.bounded_distribution(F.col("content"), F.col("tokens")).alias("b")).first().b is None
    df = respond(spark, "**Score:** 4", [("**Score:** ", 0.0, []), ("4", -3e-6, five[:4])])
    assert df.select(logprobs.bounded_distribution(F.col("content"), F.col("tokens")).alias("b")).first().b is None
    with pytest.raises(ValueError):
        logprobs.bounded_distribution(F.col("content"), F.col("tokens"), 0)


def test_labels(spark):
    five = alts(("D", 0.0), ("C", -21.5), ("E", -22.75), ("B", -23.0), ("4", -26.25))
    df = respond(spark, '{"score":"D"}', [('{"score":"', 0.0, []), ("D", 0.0, five), ('"}', 0.0, [])])
    b = df.select(logprobs.bounded_labels(F.col("content"), F.col("tokens")).alias("b")).first().b
    assert b.missing == 1 and b.score == pytest.approx(4.0, abs=1e-6)


def test_any_position(spark):
    df = respond(spark, "", [("Score", -0.1, []), ("4", -0.2, alts(("3", -1.2)))])
    d = df.select(logprobs.any_position_distribution(F.col("content"), F.col("tokens")).alias("d")).first().d
    assert d.distribution[3] == pytest.approx(math.exp(0.3) / (math.exp(0.3) + math.exp(-1.2)), abs=1e-12)
    for content, score, method in (("**Score:** 4", 4.0, "written"), ("nothing", 3.0, "default")):
        d = respond(spark, content, []).select(logprobs.any_position_distribution(F.col("content"), F.col("tokens")).alias("d")).first().d
        assert (d.score, d.method) == (score, method)


def test_valid_distribution(spark):
    rows = [({"1": 0.2, "2": 0.2, "3": 0.2, "4": 0.2, "5": 0.2}, True), ({"1": 1.0}, False), ({"1": 1.2, "2": -0.2, "3": 0.0, "4": 0.0, "5": 0.0}, False), (None, False)]
    df = spark.createDataFrame(rows, "d map<string,double>, ok boolean")
    assert all(r.v == r.ok for r in df.select("ok", logprobs.valid_distribution(F.col("d")).alias("v")).collect())


def test_arrays(spark):
    values = F.array(*(F.lit(float(i)) for i in range(5)))
    assert one(spark, arrays.window(values, F.lit(-2), F.lit(2))) == [0.0, 1.0]
    assert one(spark, arrays.window(values, F.lit(3), F.lit(99))) == [3.0, 4.0]
    assert one(spark, arrays.window(values, F.lit(4), F.lit(2))) == []
    assert one(spark, arrays.patches(values, 2)) == [[0.0, 1.0], [2.0, 3.0], [4.0, 0.0]]
    assert one(spark, arrays.patch_mask(arrays.validity(values, 8), 2)) == [True, True, True, False]
    assert one(spark, arrays.values_text(F.array(F.lit(0.125), F.lit(-0.001), F.lit(1.5)))) == "12, -0, 150"
    assert one(spark, arrays.hints("<h>", F.lit(-3), F.lit(True))) == ""
    assert one(spark, arrays.cross_entropy(F.array(F.lit(1.0), F.lit(1.0)), F.lit(0))) == pytest.approx(math.log(2))


def test_likeness_is_that_of_the_standard_library(spark):
    """On random, repetitive and edited texts, with and without popular characters."""
    import difflib
    import random

    from quillon.functions import similarity

    rng = random.Random(1)
    alphabets = ["ab", "abc", "abcdefghijklmnopqrstuvwxyz ,.", [chr(0x4E00 + k) for k in range(150)]]
    pairs = [("", ""), ("", "a"), ("abcabc" * 40, "bca" * 90), ("a" * 300, "a" * 200 + "b")]
    for _ in range(500):
        alphabet = rng.choice(alphabets)
        a, b = ("".join(rng.choice(alphabet) for _ in range(rng.choice([rng.randrange(12), rng.randrange(60), rng.randrange(190, 420)]))) for _ in range(2))
        if rng.random() < 0.5:
            edited = list(a)
            for _ in range(5):
                k = rng.randrange(len(edited) + 1)
                edited[k : k + rng.randrange(5)] = [rng.choice(alphabet) for _ in range(rng.randrange(4))]
            b = "".join(edited)
        pairs.append((a, b))
    for a, b in pairs:
        assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)
    df = spark.createDataFrame([(None, None), (None, "x"), ("xy", "xz")], "a string, b string")
    assert [r[0] for r in df.select(similarity.text_similarity("a", "b")).collect()] == [1.0, 0.0, 0.5]


def test_likeness_of_very_long_texts_takes_seconds():
    import random
    import time

    from quillon.functions import similarity

    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    a, b = (" ".join(rng.choice(words) for _ in range(33_000))[:200_000] for _ in range(2))
    edited = list(a)
    for _ in range(2000):
        edited[rng.randrange(len(edited))] = rng.choice("abc XYZ019")
    began = time.perf_counter()
    assert similarity.ratio(a, b) < similarity.ratio(a, "".join(edited))
    assert similarity.ratio("ab" * 100_000, "ba" * 100_000) == 0  # both characters are popular, and the first ones differ
    assert time.perf_counter() - began < 60
