"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order ``ORDER``: in a context, a byte
seen there n times has n of N + D parts (N bytes and D distinct ones seen), and
the escape, D parts, leads to the context shorter by one byte, whose seen bytes
are then excluded; below order 0 all bytes are equal.  Statistics are frozen
after training, so the code length of every byte in every kept context is a
number, and a text's code length is a sum of table entries.  The language with
the shortest code wins.

Trees are pruned to variable order: of the contexts of two and of three bytes
each language keeps its own most frequent ones, the others use the context
shorter by one byte.  Bytes that no training text holds are alike in every
context, so they share one column of the tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches

ORDER = 3
#: Texts of a language that are learned from, on average: the sample's bound.
TRAIN_ROWS = 2000
#: Contexts of two and of three bytes that a language keeps, each.
CONTEXTS = 12_000
#: Bytes of text that count in full for the score; more adds no certainty.
EVIDENCE = 60
#: Bytes of text that are looked up at a time; longer texts are cut.
CHUNK_BYTES = 1 << 20
HOLD_OUT = 3
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = re.compile(r"[^\W\d_]")
_BORDER = b"\n" * ORDER  # stands before each text


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """All texts in chunks: numbers of the texts, the bytes before each piece, the pieces."""
    number, before, piece, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            if size >= CHUNK_BYTES:
                yield number, before, piece
                number, before, piece, size = [], [], [], 0
            part = t[at : at + CHUNK_BYTES - size]
            number.append(i)
            before.append((_BORDER + t[max(0, at - ORDER) : at])[-ORDER:])
            piece.append(part)
            at, size = at + len(part), size + len(part)
    if number:
        yield number, before, piece


def _grams(before: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its ``ORDER`` predecessors as one number, and the pieces' sizes."""
    raw = _FOLD[np.frombuffer(b"".join(b + t for b, t in zip(before, pieces, strict=True)), dtype=np.uint8)].astype(np.uint32)
    size = np.array([len(t) for t in pieces], dtype=np.int64)
    gram = raw.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= raw[:-k] << np.uint32(8 * k)
    begin = np.cumsum(size + ORDER) - size
    keep = np.ones(len(raw), dtype=bool)
    for k in range(1, ORDER + 1):
        keep[begin - k] = False
    return gram[keep], size


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of texts and how often each occurs."""
    found = [np.unique(_grams(b, p)[0], return_counts=True) for _, b, p in _pieces(texts)]
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return gram, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def _byte(gram: np.ndarray, k: int) -> np.ndarray:
    """The byte ``k`` places before the last one."""
    return (gram >> np.uint32(8 * k)) & np.uint32(255)


@dataclass(frozen=True)
class ContextTree:
    """One language's code lengths: a row for each context of one byte and each kept longer one."""

    second: np.ndarray  # of each pair of symbols: the number of its kept context, 0 if there is none
    short: np.ndarray  # of each pair of symbols: the row of its longest context of at most two bytes
    long: np.ndarray  # of (number in second, symbol before): the row of the context of three bytes, -1 if there is none
    bits: np.ndarray  # (row, next symbol)

    def code(self, s0: np.ndarray, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray) -> np.ndarray:
        """Bits of each symbol ``s0`` after ``s3 s2 s1``."""
        a = self.bits.shape[1]
        pair = s2 * a + s1
        row = self.long[self.second[pair] * a + s3]
        row = np.where(row >= 0, row, self.short[pair])
        return self.bits.ravel()[row * a + s0]


@dataclass(frozen=True)
class LanguageModel:
    """Context trees of the languages over the bytes that were seen in training."""

    languages: list[str]
    symbol: np.ndarray  # of each byte
    trees: list[ContextTree]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language, (texts, languages)."""
        total = np.zeros((len(texts), len(self.languages)))
        for number, before, pieces in _pieces(texts):
            gram, size = _grams(before, pieces)
            s = [self.symbol[_byte(gram, k)] for k in range(ORDER + 1)]
            begin = np.cumsum(size) - size
            for column, tree in enumerate(self.trees):
                total[:, column] += np.bincount(number, weights=np.add.reduceat(tree.code(*s), begin, dtype=np.float64), minlength=len(texts))
        return total


def _mixed(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities (contexts, next symbol) from counts, escaping to ``lower`` with exclusion."""
    seen = n > 0
    total = n.sum(axis=1, keepdims=True)
    distinct = seen.sum(axis=1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(axis=1, keepdims=True)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    escape = np.where(left > 0, escape, 0.0)  # if every symbol was seen there is nothing to escape to
    own = np.where(total > 0, n / np.maximum(total, 1), 0.0) * (1 - escape)
    return own + escape * rest / np.where(left > 0, left, 1.0)


def _kept(key: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``CONTEXTS`` most frequent keys, ascending."""
    seen = np.bincount(key, weights=n, minlength=size)
    top = np.argsort(-seen, kind="stable")[:CONTEXTS]
    return np.sort(top[seen[top] > 0])


def _tree(s: list[np.ndarray], n: np.ndarray, equal: np.ndarray) -> ContextTree:
    """Tree of one language from its grams' symbols, latest first, and their counts."""
    a = len(equal)
    s0, s1, s2, s3 = s
    p = _mixed(np.bincount(s0, weights=n, minlength=a)[None, :], equal[None, :])
    one = _mixed(np.bincount(s1 * a + s0, weights=n, minlength=a * a).reshape(a, a), p)
    pair = s2 * a + s1
    kept = _kept(pair, n, a * a)
    second, short = np.zeros(a * a, dtype=np.int64), np.arange(a * a) % a
    second[kept] = np.arange(1, len(kept) + 1)
    short[kept] = a + np.arange(len(kept))
    mine = second[pair] > 0
    two = _mixed(np.bincount(((second[pair] - 1) * a + s0)[mine], weights=n[mine], minlength=len(kept) * a).reshape(-1, a), one[kept % a])
    triple = (second[pair] * a + s3)[mine]
    kept3 = _kept(triple, n[mine], (len(kept) + 1) * a)
    long = np.full((len(kept) + 1) * a, -1, dtype=np.int64)
    long[kept3] = np.arange(len(kept3))
    mine3 = long[triple] >= 0
    cell = (long[triple] * a + s0[mine])[mine3]
    three = _mixed(np.bincount(cell, weights=n[mine][mine3], minlength=len(kept3) * a).reshape(-1, a), two[kept3 // a - 1])
    long[kept3] += a + len(kept)
    with np.errstate(divide="ignore"):
        bits = -np.log2(np.concatenate([one, two, three])).astype(np.float32)
    return ContextTree(second.astype(np.int32), short.astype(np.int32), long.astype(np.int32), bits)


def build_model(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """A model from each language's grams (numbers, counts)."""
    names = sorted(grams)
    seen = np.zeros(256, dtype=bool)
    seen[10] = True  # the border
    for g, _ in grams.values():
        seen[_byte(g, 0)] = True
    known = np.flatnonzero(seen)
    rest = 256 - len(known)  # bytes that share the last symbol
    symbol = np.full(256, len(known), dtype=np.int64)
    symbol[known] = np.arange(len(known))
    equal = np.append(np.full(len(known), 1 / 256), [rest / 256] if rest else [])
    trees = [_tree([symbol[_byte(grams[x][0], k)] for k in range(ORDER + 1)], grams[x][1].astype(float), equal) for x in names]
    if rest:
        for t in trees:
            t.bits[:, -1] += np.log2(rest)  # the symbol's probability is shared evenly by its bytes
    return LanguageModel(names, symbol, trees)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = np.array([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()], dtype=object)
        for name in sorted(set(lang)):
            gram, n = gram_counts(list(texts[lang == name]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
            )


def fit_languages(docs: DataFrame, hold_out: int = HOLD_OUT) -> LanguageModel | None:
    """Learn from texts with a lang whose crc32(doc_id) modulo ``hold_out`` isn't 1.

    About ``TRAIN_ROWS`` texts of a language, by a hash of the row, are learned
    from; their distinct grams, summed in Spark, come to the driver.  None if
    there is nothing to learn from.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), hold_out) != 1, F.lit(True)))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not count:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(count.items()) for x in (k, min(1.0, TRAIN_ROWS / n)))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003
    grams = rows.filter(drawn & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = table.column("lang").to_pylist(), table.column("gram").to_numpy(), table.column("n").to_numpy()
    by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    names = np.array(lang, dtype=object)
    for name in set(lang):
        mine = names == name
        by[name] = (gram[mine].astype(np.uint32), n[mine].astype(float))
    return build_model(by) if by else None


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row, from the text only."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 256 * 4 * (256 + 2 * CONTEXTS) bytes a language, mostly a third of that

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts])
            if m is not None:
                code = m.code_lengths(texts)
                best = code.argmin(axis=1)
                size = np.array([max(1, len(t)) for t in texts])
                above = (code - code.min(axis=1, keepdims=True)) / np.maximum(1, size / EVIDENCE)[:, None]
                score = np.where(lettered, 1 / np.exp2(-np.minimum(above, 1000)).sum(axis=1), 0.0)
                lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(crc_mod(F.col("doc_id"), HOLD_OUT) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(predict, _PREDICTED)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` (doc_id, text, lang) and predict every row's language.

    ``und`` with score 0 if the text is null or has no letter, or if there was
    no language to learn.  Of languages with equal code lengths the first by
    name wins.  A null doc_id isn't held out.  lang, source and doc_id never
    enter a prediction.  Repeated rows get equal results.
    """
    return predict_languages(docs, fit_languages(docs))
