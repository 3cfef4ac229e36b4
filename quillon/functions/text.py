"""Text scalars of answer scoring, as Column functions inside the JVM.

Null texts count as empty unless a function says otherwise.  Patterns are
Unicode-aware (``(?U)``), as white space and word borders of answers are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aliases of question types after their separators are removed.
TYPE_ALIASES = {"multiplechoice": "multiple_choice", "openended": "open_ended", "truefalse": "true_false"}

#: What names a choice, in order of precedence.
CHOICE_PATTERNS = (
    r"(?iu)\b(?:answer|option|choice)\s*(?:is|:)?\s*([A-D])\b",
    r"(?iu)\b([A-D])\s*(?:is correct|is the correct|seems correct)\b",
    r"(?iu)\bthe correct answer is\s*([A-D])\b",
)
CHOICE_FIRST = r"(?iu)^([A-D])\s*[).:\-]"
CHOICE_ALONE = r"(?iu)\b([A-D])\b"
SHORT_ANSWER = 20

#: Verdicts in normalized text, in order of precedence.
VERDICT_PATTERNS = (
    (r"\b(?:answer|statement|claim)\s*(?:is)?\s*true\b", True),
    (r"\b(?:answer|statement|claim)\s*(?:is)?\s*false\b", False),
    (r"^true\b", True),
    (r"^false\b", False),
    (r"\byes\b", True),
    (r"\bno\b", False),
    (r"\btrue\b", True),
    (r"\bfalse\b", False),
)

SCORE = r"(?:\*\*)?Score(?:\*\*)?\s*:\s*(?:\*\*)?\s*\[?"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case; runs of other characters than ``a-z0-9.+-/%`` become one space."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9.+\-/%]+", " "))


def tokenize(c: Column) -> Column:
    """Tokens of the normalized text."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def _let(name: str, value: str, body: str) -> str:
    """SQL text of ``body`` with a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: First places of equal elements in an ordered array of the struct ``z``, by ``key``.
_HEADS = "filter(sequence(0, size(z.s) - 1), i -> i = 0 OR get(z.s, i){0} <> get(z.s, i - 1){0})"

_NUMBERED = "s -> CASE WHEN size(s) = 0 THEN s ELSE " + _let(
    "z", "struct(sort_array(s) AS s)",
    _let("heads", _HEADS.format(""), "flatten(transform(heads, (i, r) -> transform(sequence(1, coalesce(get(heads, r + 1), size(z.s)) - i), k -> concat(get(z.s, i), '\u0001', k))))"),
) + " END"


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its occurrence, so that sets behave as multisets."""
    return F.element_at(F.call_function("transform", F.array(tokens), F.expr(_NUMBERED)), 1)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def f1(common: Column, predicted: Column, expected: Column) -> Column:
    """Harmonic mean of precision and recall from counts; 1 if both are empty, 0 if one is."""

    def score(n: Column) -> Column:
        precision, recall = n["common"] / n["predicted"], n["common"] / n["expected"]
        return (
            F.when((n["predicted"] == 0) & (n["expected"] == 0), 1.0)
            .when((n["predicted"] == 0) | (n["expected"] == 0) | (n["common"] == 0), 0.0)
            .otherwise(2 * precision * recall / (precision + recall))
        )

    return let(F.struct(common.alias("common"), predicted.alias("predicted"), expected.alias("expected")), score)


def pair_f1(p: Column, r: Column) -> Column:
    """F1 over the common elements of two arrays, as often as they occur."""
    return let(F.struct(p.alias("p"), r.alias("r")), lambda x: f1(overlap(x["p"], x["r"]), F.size(x["p"]), F.size(x["r"])))


def token_f1(prediction: Column, reference: Column) -> Column:
    return pair_f1(tokenize(prediction), tokenize(reference))


# Sums of two words of 62 bits and a carry stay positive.
_WORDS = "(cast((z.n + 61) div 62 AS int))"
_SAME = "coalesce(nullif(cast(array_position(zip_with({0}, {1}, (s, t) -> s <=> t), false) AS int), 0) - 1, size({0}))"
_MASK = f"""aggregate(slice(z.s, i + 1, coalesce(get(heads, r + 1), z.n) - i), array_repeat(0L, {_WORDS}),
    (m, e) -> transform(m, (w, q) -> if(q = e.j div 62, w | shiftleft(1L, e.j % 62), w)))"""
_ADD = "aggregate(sequence(0, size(v) - 1), struct(cast(array() AS array<bigint>) AS words, 0L AS carry), (c, q) -> " + _let(
    "total", "get(v, q) + (get(v, q) & get(m, q)) + c.carry",
    "struct(concat(c.words, array((total & get(k.full, q)) | (get(v, q) & ~get(m, q)))) AS words, shiftright(total, 62) AS carry)",
) + ").words"
_ROW = f"aggregate(filter(y.a, t -> array_contains(k.of, t)), k.full, (v, t) -> {_let('m', 'get(k.masks, cast(array_position(k.of, t) AS int) - 1)', _ADD)})"
_FOLD = "CASE WHEN size(y.a) = 0 OR size(y.b) = 0 THEN 0 ELSE " + _let(
    "z", "struct(sort_array(transform(y.b, (t, j) -> struct(t AS t, j AS j))) AS s, size(y.b) AS n)",
    _let(
        "heads", _HEADS.format(".t"),
        _let(
            "k", f"struct(transform(heads, i -> get(z.s, i).t) AS of, transform(heads, (i, r) -> {_MASK}) AS masks, transform(sequence(0, {_WORDS} - 1), q -> shiftleft(1L, least(z.n - q * 62, 62)) - 1) AS full)",
            f"z.n - aggregate({_ROW}, 0, (c, w) -> c + bit_count(w))",
        ),
    ),
) + " END"
_LCS = "(a, b) -> " + _let(
    "n", _SAME.format("a", "b"),
    "n + " + _let(
        "x", "struct(reverse(slice(a, n + 1, size(a) - n)) AS a, reverse(slice(b, n + 1, size(b) - n)) AS b)",
        _let("m", _SAME.format("x.a", "x.b"), "m + " + _let("y", "struct(slice(x.a, m + 1, size(x.a) - m) AS a, slice(x.b, m + 1, size(x.b) - m) AS b)", _FOLD)),
    ),
)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Tokens that both begin or end with are counted as they are.  For the rest a
    bit vector over the places of ``b`` takes one addition with carries for each
    token of ``a`` that ``b`` has too; its zeros count the subsequence.  Written as SQL text,
    which the JVM parses at once; built call by call it took seconds.
    """
    return F.element_at(F.call_function("zip_with", F.array(a), F.array(b), F.expr(_LCS)), 1)


def rouge_l_f1(prediction: Column, reference: Column) -> Column:
    p, r = tokenize(prediction), tokenize(reference)
    return let(F.struct(p.alias("p"), r.alias("r")), lambda x: f1(lcs_length(x["p"], x["r"]), F.size(x["p"]), F.size(x["r"])))


def _hit(c: Column, pattern: str) -> Column:
    """First group of the first match; null without a match."""
    return F.nullif(F.regexp_extract(c, "(?U)" + pattern, 1), F.lit(""))


def extract_choice(c: Column) -> Column:
    """The option A-D that a text names; null if none."""

    def read(t: Column) -> Column:
        found = [_hit(t, p) for p in (CHOICE_FIRST, *CHOICE_PATTERNS)]
        return F.upper(F.coalesce(*found, F.when(F.length(t) <= SHORT_ANSWER, _hit(t, CHOICE_ALONE))))

    return let(strip(_text(c)), read)


def extract_true_false(c: Column) -> Column:
    """The verdict that a text states; null if none."""

    def read(norm: Column) -> Column:
        verdict = F.lit(None).cast("boolean")
        for pattern, value in reversed(VERDICT_PATTERNS):
            verdict = F.when(norm.rlike(pattern), value).otherwise(verdict)
        return verdict

    return let(normalize_text(c), read)


def extract_numbers(c: Column) -> Column:
    """Numbers of a text as they are written."""
    return F.regexp_extract_all(_text(c), F.lit(r"(?U)[-+]?\d+(?:\.\d+)?"), F.lit(0))


def numeric_f1(prediction: Column, reference: Column) -> Column:
    """F1 over the numbers of both texts; null if neither has any."""
    p, r = extract_numbers(prediction), extract_numbers(reference)
    return F.when((F.size(p) > 0) | (F.size(r) > 0), pair_f1(p, r))


def length_ratio(prediction: Column, reference: Column) -> Column:
    return F.size(tokenize(prediction)) / F.greatest(F.size(tokenize(reference)), F.lit(1))


def score_from_text(c: Column) -> Column:
    """The last ``Score: n`` of a text; null if there is none."""
    hits = F.regexp_extract_all(_text(c), F.lit("(?iUu)" + SCORE + "([1-5])"), F.lit(1))
    return F.try_element_at(hits, F.lit(-1)).cast("int")


def normalize_type(c: Column) -> Column:
    """A question type in snake case, with its common spellings."""
    snake = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]+", "_"), "^_+|_+$", "")
    out = snake
    for alias, name in TYPE_ALIASES.items():
        out = F.when(F.replace(snake, F.lit("_"), F.lit("")) == alias, name).otherwise(out)
    return out


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty; else the empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def safe_name(c: Column) -> Column:
    """A name fit for a path: other characters become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]+", "_")


def endpoint_host(c: Column) -> Column:
    return F.parse_url(c, F.lit("AUTHORITY"))
