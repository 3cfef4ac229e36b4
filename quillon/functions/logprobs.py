"""Expected scores from token log-probabilities, as Column functions.

A response's tokens are an array of
``struct<token, logprob, top_logprobs: array<struct<token, logprob>>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SCORE, let, score_from_text

DIGITS = ("1", "2", "3", "4", "5")
LABELS = ("A", "B", "C", "D", "E")
#: Prior tokens in which a hint raises a score token, the hints, and the raise.
LOOK_BACK, HINTS, RAISE = 5, ("score", "rating", "final"), 0.5
DEFAULT_SCORE = 3.0


def score_offset(content: Column, pattern: str = "(?i)" + SCORE, value: str = "[1-5]") -> Column:
    """Characters before the value of the last match; null without one."""
    head = F.regexp_extract(content, rf"(?sUu)^(.*{pattern}){value}", 1)
    return F.when(head != "", F.length(head))


def token_at(tokens: Column, offset: Column) -> Column:
    """The token that covers a character offset of the joined tokens; null if none does."""
    covered = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("at"), F.lit(-1).alias("hit"), F.lit(0).alias("i")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["token"])).alias("at"),
            F.when((s["hit"] < 0) & (s["at"] <= offset) & (offset < s["at"] + F.length(t["token"])), s["i"]).otherwise(s["hit"]).alias("hit"),
            (s["i"] + 1).alias("i"),
        ),
        lambda s: s["hit"],
    )
    return F.when(covered >= 0, F.get(tokens, covered))


def best_logs(alternatives: Column, names: tuple[str, ...], clean=lambda t: t) -> Column:
    """The greatest logprob of each name among the alternatives, null where it isn't there."""

    def best(name: str) -> Column:
        own = F.filter(alternatives, lambda a: clean(a["token"]) == F.lit(name))
        return F.array_max(F.transform(own, lambda a: a["logprob"]))

    return F.array(*map(best, names))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logs: Column) -> Column:
    """Probabilities of five logs; absent ones have 0."""
    weights = lambda x: let(F.array_max(x), lambda peak: F.transform(x, lambda v: F.coalesce(F.exp(v - peak), F.lit(0.0))))
    shares = lambda w: let(_sum(w), lambda total: F.transform(w, lambda v: v / total))
    return let(logs, lambda x: let(weights(x), shares))


def expectation(probabilities: Column) -> Column:
    """Mean of the scores 1..5."""
    return _sum(F.transform(probabilities, lambda p, i: p * (i + 1)))


def _present(logs: Column) -> Column:
    return F.size(F.filter(logs, lambda x: x.isNotNull()))


def final_distribution(content: Column, tokens: Column) -> Column:
    """Probabilities at the final score's token; null unless all five digits are there."""
    stripped = lambda t: F.regexp_replace(t, r"(?U)^[\s\[\]*]+|[\s\[\]*]+$", "")
    logs = best_logs(token_at(tokens, score_offset(content))["top_logprobs"], DIGITS, stripped)
    return let(logs, lambda x: F.when(_present(x) == 5, softmax(x)))


def fullest_distribution(tokens: Column) -> Column:
    """Probabilities at the first token with most score digits; null unless it has all five."""
    stripped = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), r"^[\[\]]+|[\[\]]+$", "")
    logs = F.transform(tokens, lambda t: best_logs(t["top_logprobs"], DIGITS, stripped))
    full = F.filter(logs, lambda x: _present(x) == 5)
    return let(F.get(full, F.lit(0)), lambda x: F.when(x.isNotNull(), softmax(x)))


def _bounded(target: Column, names: tuple[str, ...], k: int, most: float, chosen: Column | None = None) -> Column:
    def logs_of(t: Column) -> Column:
        values = F.transform(t["top_logprobs"], lambda a: a["logprob"])
        return F.struct(
            best_logs(t["top_logprobs"], names).alias("logs"), values.alias("values"), t["token"].alias("token"),
            F.transform(t["top_logprobs"], lambda a: a["token"]).alias("tokens"),
        )

    def judged(x: Column) -> Column:
        missing = F.lit(5) - _present(x["logs"])
        cutoff, peak = F.array_min(x["values"]), F.array_max(x["logs"])
        observed = _sum(F.transform(x["logs"], lambda v: F.coalesce(F.exp(v - peak), F.lit(0.0))))
        unseen = missing * F.exp(cutoff - peak)
        finite = F.forall(x["values"], lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        ok = (F.size(x["values"]) == k) & finite & (missing < 5)
        if chosen is not None:
            ok = ok & (x["token"] == chosen) & F.array_contains(x["tokens"], chosen)
        return let(unseen / (observed + unseen), lambda bound: F.when(ok & (bound <= most), result(x, missing, cutoff, bound)))

    def result(x: Column, missing: Column, cutoff: Column, bound: Column) -> Column:
        return let(
            softmax(x["logs"]),
            lambda p: F.struct(
                expectation(p).alias("score"), p.alias("distribution"), missing.alias("missing"),
                cutoff.alias("cutoff"), bound.alias("missing_mass_bound"), (4 * bound).alias("score_error_bound"),
            ),
        )

    return let(let(target, logs_of), judged)


def _check(k: int, most: float) -> None:
    if k < 1 or not 0 <= most < 1:
        raise ValueError("top-k must be positive and the missing mass lie in [0, 1)")


def bounded_distribution(content: Column, tokens: Column, k: int = 5, most: float = 1e-6) -> Column:
    """Score, distribution and error bounds at the final score's token from its top ``k``.

    An absent digit can't have more than the least of the returned logprobs; null
    if the mass that may be missing exceeds ``most``, or fewer or more than ``k``
    alternatives were returned.
    """
    _check(k, most)
    return _bounded(token_at(tokens, score_offset(content)), DIGITS, k, most)


def bounded_labels(content: Column, tokens: Column, k: int = 5, most: float = 1e-6) -> Column:
    """The same for a JSON readout ``"score": "A".."E"``, whose token must be the label itself."""
    _check(k, most)
    pattern = r'"score"\s*:\s*"'
    chosen = F.try_element_at(F.regexp_extract_all(content, F.lit(f'(?U){pattern}([A-E])"'), F.lit(1)), F.lit(-1))
    target = token_at(tokens, score_offset(content, pattern, '[A-E]"'))
    return _bounded(target, LABELS, k, most, chosen)


def any_position_distribution(content: Column, tokens: Column) -> Column:
    """Score, distribution and method from the digits at all positions.

    A digit token after a hint counts ``RAISE`` more; alternatives count as they
    are.  Without any digit the written score is taken, else ``DEFAULT_SCORE``.
    """
    stripped = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))

    def raised(x: Column) -> Column:
        start = F.greatest(x["i"] - LOOK_BACK, F.lit(0))
        before = F.lower(F.array_join(F.transform(F.slice(tokens, start + 1, x["i"] - start), lambda t: t["token"]), ""))
        hinted = before.rlike("|".join(HINTS))
        return F.struct(x["t"]["token"].alias("token"), (x["t"]["logprob"] + F.when(hinted, RAISE).otherwise(0.0)).alias("logprob"))

    own = F.transform(numbered, raised)
    others = F.flatten(F.transform(tokens, lambda t: F.coalesce(t["top_logprobs"], F.array().cast("array<struct<token:string,logprob:double>>"))))
    logs = best_logs(F.concat(own, others), DIGITS, stripped)
    written = score_from_text(content)
    nothing = F.lit(None).cast("array<double>")

    def judged(x: Column) -> Column:
        return (
            F.when(_present(x) > 0, let(softmax(x), lambda p: F.struct(expectation(p).alias("score"), p.alias("distribution"), F.lit("logprobs").alias("method"))))
            .when(written.isNotNull(), F.struct(written.cast("double").alias("score"), nothing.alias("distribution"), F.lit("written").alias("method")))
            .otherwise(F.struct(F.lit(DEFAULT_SCORE).alias("score"), nothing.alias("distribution"), F.lit("default").alias("method")))
        )

    return let(logs, judged)


def valid_distribution(distribution: Column, tolerance: float = 1e-8) -> Column:
    """Whether a map has exactly the keys 1..5 with finite values >= 0 that sum to 1."""
    keys = F.array_sort(F.map_keys(distribution))
    values = F.map_values(distribution)
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((keys == F.array(*map(F.lit, DIGITS))) & fine & (F.abs(_sum(values) - 1) <= tolerance), F.lit(False))
