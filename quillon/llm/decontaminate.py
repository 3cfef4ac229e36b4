"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit distance.

A document leaks an item if some run of its words lies within ``edits_of(n)``
word edits of the item's n words.

* CGK.  A walk reads words for a fixed number of steps from a given word on.  At
  each step it stays or goes on to the next word by a coin that word and step
  decide, so that two sequences of small edit distance fall into step again:
  edit distance becomes Hamming distance between the words read.
* LSH.  The words at a few sampled steps form a key.  Windows of the item's size
  begin at each word of a document, and keys of all of them are computed at once,
  from the last step to the first.  They are looked up in the table of the keys
  from each word of each item; a place is a candidate if any key is equal.  How
  many keys an item needs for the recall ``RECALL`` follows from its length and
  edits, by a simulation of deletions, which are the hardest edits for the walk.
* Verification.  A window around the candidate that holds the item shares at
  least n - k words with it; the exact edit distance to the best part decides.

Items without edits (up to four words) have their whole sequence as key.

Items are handled in blocks of bounded size, each against all documents; only a
block's tables are broadcast.  Documents are never shuffled.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, word_count
from .words import grams, hash_words, mix, word_spans

#: Edits allowed, as a share of an item's words.
EDIT_SHARE = 0.2
#: Share of the passages at the greatest number of edits that the search finds at least.
RECALL = 0.998
#: Items of this length or more are read for more steps.
LONG = 12
#: Steps of a walk, and steps sampled for a key: of short items, of long ones.
STEPS, SAMPLE = (7, 12), (3, 5)
#: Keys of a walk, and keys at most.
SAMPLES, MOST_KEYS = 8, 48
#: Trials of the simulation that tells the number of keys; from this length on items need no more.
TRIALS, STEADY = 2000, 24
#: Words of the items of a block: its tables take some kilobytes a word.
BLOCK_WORDS = 50_000
#: Words whose keys are computed at a time.
CHUNK = 1 << 15
#: Seeds that are spread out at a time.
SEED_BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def edits_of(n: int) -> int:
    """Word edits within which a passage still counts as an item of n words."""
    return int(n * EDIT_SHARE)


@cache
def sampled(long: bool) -> list[frozenset[int]]:
    """The sampled steps of each key."""
    rng = np.random.default_rng(11 + long)
    return [frozenset(rng.permutation(STEPS[long])[: SAMPLE[long]].tolist()) for _ in range(MOST_KEYS)]


def coins(words: np.ndarray, walk: int) -> np.ndarray:
    """A coin for each word and step of a walk, a bit a step."""
    with np.errstate(over="ignore"):
        return (mix(words ^ mix(np.uint64(walk + 1) * _ODD)) >> np.uint64(32)).astype(np.uint32)


def cgk_keys(words: np.ndarray, long: bool, keys: range) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the key, its value for the walk from each word on); words after the last one are 0.

    What a walk reads from a word and step on depends on both alone.  So from the
    last step back, a word's value is that of the next step at the same word, or
    at the next word if the coin says so, joined with the word where it is sampled.
    """
    steps = STEPS[long]
    padded = np.concatenate([words, np.zeros(steps, np.uint64)])
    for first in range(keys.start - keys.start % SAMPLES, keys.stop, SAMPLES):
        coin = coins(padded, first)
        go = [((coin >> np.uint32(t)) & np.uint32(1)).view(np.int32).astype(bool) for t in range(steps)]
        for k in range(max(first, keys.start), min(first + SAMPLES, keys.stop)):
            at, value = sampled(long)[k], np.zeros(len(padded), np.uint64)
            with np.errstate(over="ignore"):
                for t in reversed(range(steps)):
                    end = len(words) + t  # further words are out of reach at this step
                    value = np.where(go[t][:end], value[1 : end + 1], value[:end]) if t < max(at) else np.zeros(end + 1, np.uint64)[:end]
                    if t in at:
                        value = (value + padded[:end]) * _ODD
                        value ^= value >> np.uint64(29)
                    value = np.append(value, np.uint64(0))
            yield k, value[: len(words)]


def reach(words: np.ndarray, long: bool, k: int) -> np.ndarray:
    """The place of the last word that key ``k`` samples, for the walk from each word on."""
    last, n = max(sampled(long)[k]), len(words)
    at, coin = np.arange(n), coins(np.append(words, np.uint64(0)), k - k % SAMPLES)
    for t in range(last):
        at = np.minimum(at + ((coin[at] >> np.uint32(t)) & np.uint32(1)).astype(np.int64), n)
    return at


@cache
def keys_of(n: int) -> int:
    """Keys after which a passage of n words with its share of words left out is found with chance ``RECALL``.

    In half of the trials the words left out are any, in the others they are
    evenly spaced, which leaves the shortest runs.
    """
    n = min(n, STEADY)
    k, long = edits_of(n), n >= LONG
    rng = np.random.default_rng(n)
    item = rng.integers(1, 1 << 62, (TRIALS, n)).astype(np.uint64)
    gone = rng.random((TRIALS, n))
    spaced = ((np.arange(k) + rng.random((TRIALS // 2, 1))) * n / k).astype(np.int64)
    np.put_along_axis(gone[: TRIALS // 2], spaced, -1.0, axis=1)
    keep = np.sort(np.argsort(gone, axis=1)[:, k:], axis=1)
    after = rng.integers(1, 1 << 62, (TRIALS, STEPS[long])).astype(np.uint64)  # what follows the passage in the document
    passage = np.concatenate([np.take_along_axis(item, keep, axis=1), after], axis=1)
    apart = np.concatenate([item, np.zeros((TRIALS, STEPS[long]), np.uint64)], axis=1)  # walks don't reach the next trial's item
    whole = np.tile(np.arange(apart.shape[1]) < n, TRIALS)
    trial_a, trial_b = np.repeat(np.arange(TRIALS), apart.shape[1]), np.repeat(np.arange(TRIALS), passage.shape[1])
    missed = np.ones(TRIALS, bool)
    both = zip(cgk_keys(apart.ravel(), long, range(MOST_KEYS)), cgk_keys(passage.ravel(), long, range(MOST_KEYS)), strict=True)
    for (c, a), (_, b) in both:
        inside = whole & (apart.ravel()[np.minimum(reach(apart.ravel(), long, c), apart.size - 1)] != 0)
        with np.errstate(over="ignore"):
            mine, theirs = mix(a + trial_a.astype(np.uint64) * _ODD)[inside], mix(b + trial_b.astype(np.uint64) * _ODD)
        missed[trial_a[inside][np.isin(mine, theirs)]] = False
        if missed.mean() <= 1 - RECALL:
            return c + 1
    return MOST_KEYS


def best_part(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any part of ``words``, and that part's bounds."""
    m = len(words)
    steps = np.arange(m + 1)
    cost = np.zeros(m + 1, dtype=np.int64)
    start = steps.copy()
    for i, w in enumerate(item, 1):
        keep = cost[:-1] + (words != w)
        drop = cost[1:] + 1
        diagonal = keep <= drop
        value = np.concatenate([[i], np.where(diagonal, keep, drop)])
        begin = np.concatenate([[0], np.where(diagonal, start[:-1], start[1:])])
        # An extra word of the document costs one more than the cell to the left.
        low = np.minimum.accumulate(value - steps)
        source = np.maximum.accumulate(np.where(value - steps == low, steps, 0))
        cost, start = low + steps, begin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``lo .. lo + n``, one after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def merged(pair: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of a pair's overlapping ranges."""
    if not len(pair):
        return pair, lo, hi
    order = np.lexsort((lo, pair))
    pair, lo, hi = pair[order], lo[order], hi[order]
    new = np.diff(pair, prepend=-1) != 0
    shift = np.cumsum(new) * (int(hi.max()) + 1)  # ranges of another pair never reach over
    reach = np.maximum.accumulate(hi + shift)
    new[1:] |= lo[1:] + shift[1:] >= reach[:-1]
    at = np.flatnonzero(new)
    return pair[at], lo[at], np.maximum.reduceat(hi, at)


class Lookup:
    """Places (item, word of the item) by key."""

    def __init__(self, found: list[tuple[np.ndarray, int, np.ndarray]]):
        """``found``: keys, number of the item, places in the item."""
        keys = np.concatenate([g for g, _, _ in found])
        order = np.argsort(keys, kind="stable")
        self.item = np.concatenate([np.full(len(g), n) for g, n, _ in found])[order]
        self.place = np.concatenate([p for _, _, p in found])[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        # A bit table of some 32 cells a key, a byte each, tells most keys that are not there.
        self._shift = np.uint64(64 - min(20, max(8, (32 * len(self.keys)).bit_length())))
        self._bits = np.zeros(1 << (64 - int(self._shift)), dtype=bool)
        self._bits[(self.keys >> self._shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given keys are there, and where."""
        hit = np.flatnonzero(self._bits[(keys >> self._shift).astype(np.int64)]) if len(self.keys) else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        same = self.keys[at] == keys[hit]
        return hit[same], at[same]


class ItemTables:
    """What a block of items is looked up by."""

    def __init__(self, items: list[tuple[int, str]]):
        words = {i: hash_words([t.encode("utf-8", "replace")])[0] for i, t in items}
        self.words = {i: w for i, w in words.items() if len(w)}
        self.ids = list(self.words)
        self.size = np.array([len(w) for w in self.words.values()], dtype=np.int64)
        self.edits = np.array([edits_of(len(w)) for w in self.words.values()], dtype=np.int64)
        self.distinct = [np.unique(w) for w in self.words.values()]
        #: Length -> whole items without edits.
        self.whole = {}
        for q in sorted(set(self.size[self.edits == 0].tolist())):
            own = np.flatnonzero(self.size == q).tolist()
            self.whole[q] = Lookup([(grams(self.words[self.ids[n]], q), n, np.zeros(1, np.int64)) for n in own])
        #: (long items?, key) -> their places.
        self.keyed: dict[bool, dict[int, Lookup]] = {}
        for long in (False, True):
            own = [n for n in range(len(self.ids)) if self.edits[n] and (self.size[n] >= LONG) == long]
            found: dict[int, list] = {}
            for n in own:
                w = self.words[self.ids[n]]
                for k, keys in cgk_keys(w, long, range(keys_of(len(w)))):
                    inside = np.flatnonzero(reach(w, long, k) < len(w))
                    found.setdefault(k, []).append((keys[inside], n, inside))
            self.keyed[long] = {k: Lookup(x) for k, x in sorted(found.items())}

    def _spread(self, lookup: Lookup, hit: np.ndarray, at: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document * items + item, first word, end word) around places ``hit`` with keys ``at``, in slices."""
        doc = np.searchsorted(off, hit, side="right") - 1
        n = lookup.first[at + 1] - lookup.first[at]
        total = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SEED_BLOCK, side="right")))
            k = _ranges(lookup.first[at[a:b]], n[a:b])
            i, d = lookup.item[k], np.repeat(doc[a:b], n[a:b])
            begin = np.repeat(hit[a:b], n[a:b]) - lookup.place[k]
            lo = np.maximum(off[d], begin - self.edits[i])
            hi = np.minimum(off[d + 1], begin + self.size[i] + self.edits[i])
            yield d * len(self.ids) + i, lo, hi
            a = b

    def seeds(self, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document * items + item, first word, end word) of the bounds around each equal key, in slices."""
        for q, lookup in self.whole.items():
            if len(h) >= q:
                yield from self._spread(lookup, *lookup.find(grams(h, q)), off)
        for long, lookups in self.keyed.items():
            for a in range(0, len(h) if lookups else 0, CHUNK):
                words = h[a : a + CHUNK + STEPS[long]]  # keys of the last words are those of the next chunk
                for k, keys in cgk_keys(words, long, range(max(lookups) + 1)):
                    hit, at = lookups[k].find(keys[:CHUNK])
                    if len(hit):
                        yield from self._spread(lookups[k], hit + a, at, off)

    def places(self, h: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, number of the item, first word, end word) of all places with an equal key and enough words of an item."""
        none = np.empty(0, dtype=np.int64)
        pair, lo, hi = none, none, none
        waiting, size = [], 0
        for found in self.seeds(h, off):
            waiting.append(found)
            size += len(found[0])
            if size > SEED_BLOCK:
                pair, lo, hi = merged(*(np.concatenate(x) for x in zip((pair, lo, hi), *waiting, strict=True)))
                waiting, size = [], 0
        pair, lo, hi = merged(*(np.concatenate(x) for x in zip((pair, lo, hi), *waiting, strict=True)))
        for p, a, b in zip(pair.tolist(), lo.tolist(), hi.tolist(), strict=True):
            d, i = divmod(p, len(self.ids))
            n, k = int(self.size[i]), int(self.edits[i])
            words = self.distinct[i]
            at = np.minimum(np.searchsorted(words, h[a:b]), len(words) - 1)
            shared = np.concatenate([[0], np.cumsum(words[at] == h[a:b])])
            wide = min(n + k, b - a)
            full = np.flatnonzero(shared[wide:] - shared[: len(shared) - wide] >= n - k)
            if len(full):
                yield d, i, a + int(full[0]), a + int(full[-1]) + wide

    def matches(self, h: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (edits, first word, end word) of the best passage within the edits."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, lo, hi in self.places(h, off):
            item = self.ids[i]
            edits, a, b = best_part(self.words[item], h[lo:hi])
            found = (edits, lo + a - int(off[d]), lo + b - int(off[d]))
            if edits <= self.edits[i] and ((d, item) not in out or found < out[d, item]):
                out[d, item] = found
        return out


_LEAKS = "doc_id long, item_id long, edits int, item_words int, start long, end long"


def _item_blocks(benchmark: DataFrame) -> Iterator[tuple["ItemTables", list[int]]]:
    """Tables of one block of items after the other, and the items' ids."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "text is not null"
    ).distinct()
    blocks = max(1, -(-(items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0) // BLOCK_WORDS))
    for k in range(blocks):  # a stated query set, block by block against all documents
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        # Texts of a repeated item_id get numbers of their own.
        yield ItemTables([(n, t) for n, (_, t) in enumerate(rows)]), [i for i, _ in rows]


def _leaking(shared: Broadcast):
    @F.pandas_udf("boolean")
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables, _ = shared.value
        for text in parts:
            found = {d for d, _ in tables.matches(*hash_words([(t or "").encode("utf-8", "replace") for t in text]))}
            yield pd.Series([d in found for d in range(len(text))], dtype=bool)

    return leaks


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any columns, text among them) that leak no item.

    Each row is judged in place by its text; nothing is joined or shuffled, so
    null and repeated ids make no difference.
    """
    small_batches(docs.sparkSession)
    out = docs
    for block in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.filter(~_leaking(shared)(F.col("text").cast("string")))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, item_words, start, end)`` of every leaked item of every document.

    ``start`` and ``end`` bound the passage in code points of the text.  One row
    for each row of ``docs`` and item, with the passage of the fewest edits (the
    first of equals).  Null or blank texts hold nothing; items without a word are
    in no document; an item of under five words allows no edit.  Items without
    item_id are reported with null; of an item_id that occurs with several texts
    each is searched for.  Documents without doc_id are searched
    and reported with null.  An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables, names = shared.value
            for batch in batches:
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                ids = batch.column("doc_id").to_pylist()
                rows: dict[tuple[int, int], tuple] = {}
                for (d, item), (edits, a, b) in tables.matches(*hash_words(texts)).items():
                    begin, end, _ = word_spans(texts[d])
                    start = len(texts[d][: begin[a]].decode("utf-8", "replace"))
                    stop = start + len(texts[d][begin[a] : end[max(a, b - 1)]].decode("utf-8", "replace"))
                    row = (edits, start, stop, len(tables.words[item]))
                    rows[d, names[item]] = min(row, rows.get((d, names[item]), row))
                flat = [(ids[d], i, e, n, s, t) for (d, i), (e, s, t, n) in sorted(rows.items(), key=lambda r: (r[0][0], r[0][1] is None, r[0][1] or 0))]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*flat, strict=True) if flat else [[]] * 6
                names_ = ["doc_id", "item_id", "edits", "item_words", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names_)

        found = docs.mapInArrow(search, _LEAKS)
        out = found if out is None else out.unionByName(found)
    return out
