"""Merkle manifest, divergence and substring removal against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillon.llm import divergence, merkle, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the seven result columns, as a multiset."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, n: H(*map(field, (r[0], r[3], r[2], n, r[1])))

    def up(level):
        return [H(*level[k : k + 2]) for k in range(0, len(level), 2)]

    def climb(level, i):
        out = []
        while len(level) > 1:
            out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
            level, i = up(level), i // 2
        return level[0], out

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
    roots = [climb([x[2] for x in by[g]], 0)[0] for g in langs]
    out = Counter()
    for k, g in enumerate(langs):
        leaves = [x[2] for x in by[g]]
        for i, (*_, r) in enumerate(by[g]):
            (subroot, low), (root, high) = climb(leaves, i), climb(roots, k)
            node = leaves[i]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf(r, r[4] + 1)
            for right, other in low + high:
                node = H(node) if other is None else H(other, node) if right else H(node, other)
            proof = H(*(x for _, x in low + high if x is not None))
            out[r[0], leaves[i], subroot, root, proof, node, node == root] += 1
    return out


def manifest(spark, rows, **options):
    return Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS), **options).collect())


def some_rows(n: int, langs: int, seed: int = 1):
    rng = random.Random(seed)
    return [(d, f"text {d % 7} é", f"l{rng.randrange(langs)}", f"s{d % 3}", d) for d in rng.sample(range(10 * n), n)]


def test_manifest_of_hard_rows(spark):
    rows = [(None, None, None, None, None), (None, "x", None, None, 3), (4, "", "", "", 0), (4, "", "", "", 0), (4, "other", "", "s", 1), (-5, "ä" * 50_000, "en", "s", 1), (7, "x", "é", "s", None)]
    rows += [(7 * k, "same", "en", "s", 4) for k in range(40)]
    got = manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert {x[-1] for x in got} == {True, False}
    assert manifest(spark, []) == Counter()
    assert manifest(spark, rows[:1]) == plain_manifest(rows[:1])


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049])
def test_manifest_at_the_borders_of_blocks(spark, n):
    rows = some_rows(n, 1)
    assert manifest(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("n, langs, top", [(300, 2, 8), (60, 50, 3)])
def test_upper_tree_in_blocks_and_very_many_languages(spark, n, langs, top):
    rows = some_rows(n, langs)
    assert manifest(spark, rows, top=top, levels=2) == plain_manifest(rows)


def test_a_wrong_sibling_does_not_verify():
    nodes = [H(str(k)).encode() for k in range(11)]
    levels = merkle.tower(nodes, merkle.depth(11))
    root = levels[-1][0]
    for i, node in enumerate(nodes):
        path = merkle.steps(levels, i)
        assert merkle.fold(node, path) == root
        assert merkle.fold(nodes[i - 1], path) != root
        flipped = path[:-1] + bytes([path[-1] ^ 1])
        assert merkle.fold(node, flipped) != root or path[-merkle._STEP] == 0


def plain_divergence(rows, least, top):
    """Every group laid out over all kept terms."""
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in ((r[1] or "", r[2] or "", r[3] or "") for r in rows):
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(az))
        for t in found:
            n[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang, source in groups:
        kept = sorted(t for (g, t), k in docs.items() if g == lang and k >= least)

        def share(s, t, lang=lang, kept=kept):
            of = [x for g, x in groups if g == lang] if s is None else [s]
            total = sum(n[lang, x, y] for x in of for y in kept)
            return 1 + 1_000_000_000 * (sum(n[lang, x, t] for x in of) + 5) // (total + 5 * len(kept))

        pairs = [(sum(abs(share(source, t) - share(s, t)) for t in kept), s) for g, s in groups if g == lang and s != source]
        own = [(share(source, t) - share(None, t), t) for t in kept if n[lang, source, t] and share(source, t) > share(None, t)]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return Counter(out)


def diverged(spark, rows, **options):
    return Counter(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, DOCS), **options).collect())


def test_divergence_equals_all_groups_over_all_terms(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcÄé漢" for b in "xyzQ"]
    rows = []
    for d in range(160):
        source = rng.choice(["s0", "s0", "s1", "s2", None, "S1", "é"])
        own = rng.sample(words, 6) if source != "s0" else words[:4]
        text = rng.choice([" ", ",", "\x00", "9"]).join(rng.choice(own) for _ in range(rng.randrange(0, 30)))
        rows.append((d, text, rng.choice(["en", "en", "fr", None]), source, 1))
    rows += [(900, None, "xx", "s0", 0), (901, "", "xx", "s1", 0), (902, "rare", "yy", "alone", 0)]
    got = diverged(spark, rows, least=5, top=3)
    assert got == plain_divergence(rows, 5, 3)
    assert {x[2] for x in got} == {"pair", "term"} and ("xx", "s0", "pair", "s1", 0, 1) in got
    assert not [x for x in got if x[0] == "yy"] and diverged(spark, []) == Counter()


def test_divergence_without_kept_terms_and_in_many_parts(spark, monkeypatch):
    rows = [(d, f"w{d}", "en", f"s{d:03}", 1) for d in range(40)]
    assert set(diverged(spark, rows).values()) == {1} and {x[4] for x in diverged(spark, rows)} == {0}
    monkeypatch.setattr(divergence, "PART", 7)
    assert diverged(spark, rows, least=1, top=2) == plain_divergence(rows, 1, 2)


def test_task_tables_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 9, "source": ["s"] * 9, "text": [f"x y{chr(97 + k)} z{chr(98 + k)}" for k in range(9)]})
    parts = list(divergence._count(iter([batch])))
    assert len(parts) > 2
    total = Counter()
    for p in parts:
        for r in p.to_pylist():
            total[r["term"]] += r["n"]
    assert total["x"] == 9 and sum(total.values()) == 27


def plain_substring(rows):
    """(doc_id, n_words, n_removed, digest of the words that stay), as a multiset."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first: dict = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 12) if r[0] is not None and first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        out[r[0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


def substring_rows(seed: int):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(13, 70))] for _ in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(1, 60)] if rng.random() < 0.8 else [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        rows.append((rng.choice([None, d, d, d, 5]), rng.choice([" ", "\n", " \t "]).join(parts), None, None, None))
    rows += [(300 + k, " ".join(["la"] * k), None, None, None) for k in (0, 12, 13, 14, 40)]  # ties of all hashes
    rows += [(400, None, None, None, None), (401, "Case " + " ".join(pool[0]).upper(), None, None, None), (-3, " ".join(pool[1]), None, None, None), (-3, " ".join(pool[1]), None, None, None)]
    return rows


def deduplicated(spark, rows, **options):
    out = substring.deduplicated(spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "block").repartition(5), **options)
    return out.collect()


@pytest.mark.parametrize("hot", [substring.HOT, 1, 0])
def test_substring_equals_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    for seed in (1, 2):
        rows = substring_rows(seed)
        got = deduplicated(spark, rows, hot=hot)
        want = plain_substring(rows)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
        assert sum(x[2] > 0 for x in want) > 20
    assert deduplicated(spark, []) == []


def test_substring_of_long_and_common_texts(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(5000)}" for _ in range(30_000)]
    rows = [(0, " ".join(base), None, None, None), (1, " ".join(base[100:25_000]), None, None, None)]
    rows += [(2 + k, f"x{k} " + " ".join(base[500:520]) + f" y{k}", None, None, None) for k in range(300)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in deduplicated(spark, rows))
    assert got == plain_substring(rows)


def test_greedy_factors_find_the_earliest_document_of_each_window():
    rng = random.Random(4)
    for _ in range(300):
        reference, first = substring.Reference(), {}
        for doc in range(8):
            words = [rng.choice([b"a", b"b"]) if rng.random() < 0.1 else b"a" for _ in range(rng.randrange(13, 40))]
            got = reference.parse(words, doc)
            windows = [tuple(words[i : i + 13]) for i in range(len(words) - 12)]
            for w in windows:
                first.setdefault(w, doc)
            assert got == [first[w] for w in windows]
