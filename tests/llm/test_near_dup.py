"""Near-duplicates and components against all pairs compared in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import near_dup
from quillon.llm.components import connected_components
from quillon.llm.words import hash_words

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(400)]


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_AZ))


def shingles_of(text: str | None) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles_of(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def found(spark, rows, schema="doc_id long, text string"):
    out = near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


def edited(rng: random.Random, words: list[str], edits: int) -> str:
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_groups_of_copies_chains_and_short_texts(spark):
    rng = random.Random(3)
    rows, next_id = [], iter(range(10_000))
    for edits in (0, 1, 1, 2, 3, 4):
        base = rng.choices(WORDS, k=rng.randint(40, 160))
        rows += [(next(next_id), edited(rng, base, rng.randint(0, edits))) for _ in range(12)]
    chain = rng.choices(WORDS, k=120)
    for _ in range(15):  # each like the one before, the ends unlike
        chain[rng.randrange(120)] = rng.choice(WORDS)
        chain[rng.randrange(120)] = rng.choice(WORDS)
        rows.append((next(next_id), " ".join(chain)))
    shared = " ".join(rng.choices(WORDS, k=60))  # a passage in texts that aren't near
    rows += [(next(next_id), shared + " " + " ".join(rng.choices(WORDS, k=120))) for _ in range(10)]
    rows += [(next(next_id), t) for t in ("a b c", "A  b\tC", "a b", "a b c d e", "a b c d e f", "Ä b c", "ä b c", " ", "", None, " ")]
    rng.shuffle(rows)
    assert found(spark, rows) == brute_force(rows)


def test_one_large_group_needs_all_three_searches(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(8)
    base = rng.choices(WORDS, k=70)
    rows = [(i, edited(rng, base, rng.randint(0, 4))) for i in range(150)]
    assert found(spark, rows) == brute_force(rows)


def test_parts_of_a_star_are_confirmed_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR_ROWS", 4)
    rng = random.Random(9)
    base = rng.choices(WORDS, k=90)
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(100)]
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_complementary_words_are_not_linked(spark, n):
    """Words that hashes by polynomials modulo a power of 2 can't tell apart."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word), (4, f"{word} c d e f g h i"), (5, f"{other} c d e f g h i")]
    assert found(spark, rows) == brute_force(rows)


def test_the_registered_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 5), (1, text, 6), (None, text, 7), (2, text.upper(), 8), (3, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert out == [(0, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True)] or out[1:] == [
        (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True),
    ]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_a_very_long_text_has_all_its_shingles(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "x1 x2 x3 x4 x5 x6")]
    assert found(spark, rows) == {1: (59_996, 1, True), 2: (59_997, 1, False), 3: (2, 3, True)}


def test_signature_values_are_all_minima_and_maxima():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at, value in ((0, near_dup.signature(s)[0]), (7, near_dup.signature(s)[7])):
        assert value == (near_dup._ODD[at] * x).min()
    assert near_dup.signature(s)[near_dup.PERMUTATIONS + 3] == (near_dup._ODD[3] * x).max()


def test_min_max_signatures_estimate_similarity_without_bias():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        s = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = near_dup.signature(s[:300]), near_dup.signature(s[100:])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.015


def test_hashes_depend_on_folded_bytes_only():
    h, off = hash_words([b"Abc  def\n", b"", b"DEF\x0babc"])
    assert off.tolist() == [0, 2, 2, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(25)] + [(5, 5), (None, 3)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(out) == len(root)
    assert {r.node: r.root for r in out} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
