"""Benchmark leaks against edit distances of all items to all documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import decontaminate as D
from quillon.llm.words import hash_words

WORDS = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string, item_id int"
ITEMS = "item_id long, text string, doc_id int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def best(item: list[str], doc: list[str]) -> int:
    """Least edit distance of the item to any part of the document."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_force(docs, items):
    out = {}
    for d, t in docs:
        for i, u in items:
            w = words_of(u)
            if w and t:
                k = best(w, words_of(t))
                if k <= D.edits_of(len(w)):
                    out[d, i] = k
    return out


def planted(rng: random.Random, items, n: int):
    docs = []
    for d in range(n):
        body = rng.choices(WORDS, k=rng.randint(0, 150))
        if d % 2:
            w = words_of(rng.choice(items)[1])
            for _ in range(rng.randint(0, int(0.3 * len(w)))):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind != 0)] = [] if kind == 2 else [rng.choice(WORDS)]
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((d, " ".join(body)))
    return docs


@pytest.mark.parametrize("seed, block", [(1, 500_000), (2, 200)])
def test_leaks_against_all_distances(spark, monkeypatch, seed, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(30)]
    docs = planted(rng, items, 160)
    want = brute_force(docs, items)
    rows = D.find_leaks(spark.createDataFrame([(*r, 0) for r in docs], DOCS), spark.createDataFrame([(*r, 0) for r in items], ITEMS)).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert len(got) == len(rows)
    assert not got.keys() - want.keys()  # verified exactly: no false alarm
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want)
    text = dict(docs)
    item = {i: words_of(t) for i, t in items}
    for r in rows:
        assert best(item[r.item_id], words_of(text[r.doc_id][r.start : r.end])) == r.edits and r.item_words == len(item[r.item_id])
    kept = {r.doc_id for r in D.without_leaks(spark.createDataFrame([(*r, 0) for r in docs], DOCS), spark.createDataFrame([(*r, 0) for r in items], ITEMS)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_the_table_against_all_distances_of_its_exact_passages(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    norm = lambda t: " " + " ".join(words_of(t)) + " "
    text = {r.doc_id: norm(r.text) for r in docs.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in text.items() if norm(r.text) in t}
    assert exact <= got


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, f"ÄÖ before {passage.upper()}\tafter", 0), (1, f"x {passage}", 0), (None, passage, 0), (2, None, 0), (3, "", 0), (4, "five six", 0), (5, "a " * 100_000 + passage, 0)]
    items = [(7, passage, 0), (7, passage, 0), (7, "another text of six words", 0), (8, None, 0), (None, passage, 0), (9, "one two", 0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    out = sorted((r.doc_id or 0, r.item_id or 0, r.edits, r.start) for r in D.find_leaks(d, b).collect())
    assert out == sorted((d, i, 0, s) for d, s in [(0, 0), (1, 2), (1, 10), (5, 200_000)] for i in (0, 7, 9))
    assert sorted(r.doc_id for r in D.without_leaks(d, b).collect()) == [2, 3, 4]
    assert D.without_leaks(d, b).columns == d.columns
    assert D.find_leaks(d.limit(0), b).collect() == [] and D.find_leaks(d, b.limit(0)).collect() == []
    assert D.without_leaks(d, b.limit(0)).count() == len(docs)


def plain_key(words: np.ndarray, start: int, long: bool, k: int) -> tuple[int, int]:
    """A key by walking forward, and the place of the last word that it samples."""
    padded = np.concatenate([words, np.zeros(99, np.uint64)])
    coin = D.coins(padded, k - k % D.SAMPLES)
    at, read = start, []
    for t in range(max(D.sampled(long)[k]) + 1):
        read.append(at)
        at += int(coin[at]) >> t & 1
    value = 0
    for t in sorted(D.sampled(long)[k], reverse=True):
        value = (value + int(padded[read[t]])) * int(D._ODD) % 2**64
        value ^= value >> 29
    return value, read[-1]


@pytest.mark.parametrize("long", [False, True])
def test_keys_from_the_last_step_back_are_those_of_walks(long):
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 40):
        words = rng.integers(1, 1 << 62, n).astype(np.uint64)
        got = dict(D.cgk_keys(words, long, range(3, 11)))
        assert sorted(got) == list(range(3, 11))
        for k, keys in got.items():
            plain = [plain_key(words, i, long, k) for i in range(n)]
            assert keys.tolist() == [v for v, _ in plain] and np.minimum(D.reach(words, long, k), n).tolist() == [min(r, n) for _, r in plain]


def test_the_walk_keeps_keys_over_an_edit():
    """Keys from the words before a missing word on are often those of the whole text, as no word run over it is."""
    rng = np.random.default_rng(5)
    kept = total = far = 0
    for _ in range(60):
        a = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        b = np.concatenate([a[:20], a[21:]])
        c = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        for (k, x), (_, y), (_, z) in zip(*(D.cgk_keys(w, True, range(16)) for w in (a, b, c)), strict=True):
            over = (D.reach(a, True, k)[14:19] > 20) & (D.reach(b, True, k)[14:19] >= 20)
            kept, total = kept + (x[14:19] == y[14:19])[over].sum(), total + over.sum()
            far += (x == z)[:28].sum()  # walks from there on stay inside
    assert kept > 0.1 * total > 0 and far == 0


def test_results_vanish_without_the_embedding(monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(5, 40)))) for i in range(10)]
    h, off = hash_words([t.encode() for _, t in items])
    tables = D.ItemTables(items)
    assert len(tables.matches(h, off)) >= 10
    real = D.cgk_keys
    monkeypatch.setattr(D, "cgk_keys", lambda *a: ((k, np.zeros_like(v)) for k, v in real(*a)))
    assert tables.matches(h, off) == {}


def test_best_part_is_the_edit_distance():
    rng = random.Random(7)
    for _ in range(60):
        item, doc = rng.choices("abcd", k=rng.randint(1, 12)), rng.choices("abcd", k=rng.randint(0, 25))
        h, off = hash_words([" ".join(item).encode(), " ".join(doc).encode()])
        edits, a, b = D.best_part(h[: off[1]], h[off[1] :])
        assert edits == best(item, doc) == best(item, doc[a:b])


@pytest.mark.parametrize("n", [100, 200, 300])
def test_long_items_with_words_left_out(n):
    rng = random.Random(n)
    for trial in range(12):
        item = rng.choices(WORDS, k=n)
        k = D.edits_of(n) - (trial % 3 == 2)
        kept = sorted(rng.sample(range(n), n - k))
        doc = rng.choices(WORDS, k=50) + [item[i] for i in kept] + rng.choices(WORDS, k=rng.randint(0, 50))
        found = D.ItemTables([(7, " ".join(item))]).matches(*hash_words([b"other words", " ".join(doc).encode()]))
        assert [(key, v[0]) for key, v in found.items()] == [((1, 7), best(item, doc))]


def test_short_items_are_searched_exactly():
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta alpha beta"), (4, "a b c d")]
    docs = ["x alpha y", "beta x gamma", "delta alpha beta gamma", "a b c d", "a b c e", ""]
    found = D.ItemTables(items).matches(*hash_words([t.encode() for t in docs]))
    assert {k: v[0] for k, v in found.items()} == brute_force(list(enumerate(docs)), items)


@pytest.mark.parametrize("n", [5, 10, 16, 30, 45, 60, 120])
def test_recall_at_the_most_deletions(n):
    """Every passage has as many words left out as is allowed, at any places or evenly spaced."""
    rng = random.Random(n)
    lost, trials = 0, 200
    for trial in range(trials):
        item = rng.choices(WORDS, k=n)
        k = D.edits_of(n)
        kept = sorted(rng.sample(range(n), n - k)) if trial % 2 else [i for i in range(n) if (i + trial) * k % n >= k]
        words = rng.choices(WORDS, k=10) + [item[i] for i in kept] + rng.choices(WORDS, k=20)
        h, off = hash_words([" ".join(words).encode()])
        lost += not D.ItemTables([(7, " ".join(item))]).matches(h, off)
    assert lost <= 0.01 * trials


@pytest.mark.parametrize("seeds", [1 << 20, 5])
def test_every_leak_is_found_where_words_repeat(monkeypatch, seeds):
    monkeypatch.setattr(D, "SEED_BLOCK", seeds)
    rng = random.Random(seeds)
    few = WORDS[:4]
    items = [(i, " ".join(rng.choices(few, k=rng.randint(5, 40)))) for i in range(8)]
    docs = [(d, " ".join(rng.choices(few, k=rng.randint(0, 80)))) for d in range(30)]
    found = D.ItemTables(items).matches(*hash_words([t.encode() for _, t in docs]))
    assert {key: v[0] for key, v in found.items()} == brute_force(docs, items)
