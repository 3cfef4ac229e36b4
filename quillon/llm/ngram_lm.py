"""Word bigram scores by deleted interpolation.

P(w | h) mixes c(h, w) / c(h), c(w) / N and 1 / (V + 1).  The weights depend on
a bucket of c(h), the context's frequency, and are learned by expectation
maximisation on a held-out part of the training texts, whose own counts are
deleted from all counts for that purpose.

Counts follow the corpus, so nothing of them goes to the driver or is broadcast.
Documents are dealt to blocks of bounded size.  A block sends its distinct keys
(64-bit hashes of words and word pairs), sorted, by key range; each range adds
up what was sent and answers in the sender's own order, so an answer carries
counts only.  Blocks then score their documents.  What is shuffled are the texts,
to their blocks, twice (for the question and for the scores), and a block's distinct
keys; no row is sent for a token.

A block sends at most ``FANOUT`` messages.  If that many ranges are too few, the
exchange has several levels, like the digits of a number: a node adds up what
``fan`` senders sent for one range, sends the sums on for the range's parts, and
passes the answers back.  So the messages grow in proportion to the blocks (times
the levels: one up to 256 blocks, two up to 65,536, three up to 16 million).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches
from .words import hash_words, mix

#: Rows whose crc32(doc_id) modulo this is 0 aren't learned from.
HOLD_OUT = 10
#: Bytes of text of an average block.
BLOCK_BYTES = 16 << 20
#: Most messages that a block or a node of the exchange sends.
FANOUT = 256
#: One in so many documents is in the part on which the weights are learned.
FOLD = 10
ADD = 0.1
EM_ROUNDS = 200
#: Bucket k > 0 holds contexts seen 2**(k-1) .. 2**k - 1 times, the last all above.
BUCKETS = 24
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_STEP = 8.0  # cells of the held-out events are 1/8 wide in natural logarithms


def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers in as few bytes each as the largest one needs, bytes of equal weight side by side."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, dtype=np.uint64)
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and their steps."""
    return keys[:1].tobytes() + pack(np.diff(keys)) if len(keys) else b""


def _unpack_keys(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([np.frombuffer(b, "<u8", count=1), unpack(b[8:])]), dtype=np.uint64)


class _Block:
    """Tokens of a block's documents and their distinct words and pairs."""

    def __init__(self, docs: pa.Table):
        texts = [x or b"" for x in docs.column("text").cast(pa.binary()).to_pylist()]
        words, off = hash_words(texts)
        n = np.diff(off)
        self.docs = len(texts)
        self.first = off[:-1] + np.arange(self.docs)
        last = self.first + n
        token = np.empty(len(words) + self.docs, dtype=np.uint64)
        inner = np.ones(len(token), dtype=bool)
        inner[last] = False
        token[inner] = words
        token[last] = _END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.first] = _START
        self.tokens = n + 1
        self.trained = np.repeat(~docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool), self.tokens)
        self.words, self.word = np.unique(token, return_inverse=True)
        with np.errstate(over="ignore"):
            pair = mix(context * np.uint64(0x100000001B3) + token)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        end = np.searchsorted(self.words, _END)
        self.context = np.empty(len(token), dtype=np.int64)  # the place of the context's count
        self.context[1:] = self.word[:-1]
        self.context[self.first] = end  # as many starts as ends


_KINDS = ("word", "pair")
_ASK = "node long, member long, fold boolean, word_keys binary, word_n binary, word_part binary, pair_keys binary, pair_n binary, pair_part binary"
_ANSWER = "member long, digit int, word_n binary, word_part binary, pair_n binary, pair_part binary, n_distinct long, n_tokens long, n_fold long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(c, _ARROW[t]) for (n, t), c in zip(fields, columns, strict=True)})


def _is_fold(block: int) -> bool:
    return block % FOLD == 1


class Exchange:
    """Numbers of the nodes that blocks and nodes exchange counts with.

    A node of a level stands for ``fan ** level`` blocks and one of as many key
    ranges; the last level's nodes stand for all blocks.  Blocks are level 0.
    """

    def __init__(self, blocks: int):
        self.levels, self.fan = 1, min(blocks, FANOUT)
        while self.fan**self.levels < blocks:
            self.levels += 1

    def send(self, sender: int, level: int, fold: bool, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        """Messages of a block or node: its (keys, counts, counts in the fold) by the next level's ranges."""
        group, path = divmod(sender, self.fan**level)
        parts = self.fan ** (level + 1)
        first = path * self.fan
        edges = [((first + d) << 64) // parts for d in range(1, self.fan)]
        bounds = [np.concatenate([[0], np.searchsorted(k, np.array(edges, dtype=np.uint64)), [len(k)]]) for k, _, _ in counts]
        rows = []
        for d in range(self.fan):
            row: list = [group // self.fan * parts + first + d, sender, fold]
            for (keys, n, part), at in zip(counts, bounds, strict=True):
                s = slice(at[d], at[d + 1])
                row += [_pack_keys(keys[s]), pack(n[s]), pack(part[s]) if part[s].any() else b""]
            rows.append(tuple(row))
        return _table(rows, _ASK)

    def ask(self, key: tuple, docs: pa.Table) -> pa.Table:
        """Messages of a block."""
        block = key[0].as_py()
        b = _Block(docs)
        counts = []
        for keys, place in ((b.words, b.word), (b.pairs, b.pair)):
            n = np.bincount(place, weights=b.trained, minlength=len(keys)).astype(np.uint64)
            counts.append((keys, n, n if _is_fold(block) else np.zeros_like(n)))
        return self.send(block, 0, _is_fold(block), counts)

    def pass_on(self, level: int):
        """Messages of a node: the sums of what it was sent."""

        def up(key: tuple, asked: pa.Table) -> pa.Table:
            sums = [_Sums(asked, kind) for kind in _KINDS]
            return self.send(key[0].as_py(), level, any(asked.column("fold").to_pylist()), [(s.keys, s.n, s.part) for s in sums])

        return up

    def answer(self, key: tuple, asked: pa.Table) -> pa.Table:
        """A node of the last level: its sums are those of all blocks."""
        sums = [_Sums(asked, kind) for kind in _KINDS]
        words = sums[0]
        stats = (int((words.n > 0).sum()), int(words.n.sum()), int(words.part.sum()))
        return self._answers(key[0].as_py(), asked, sums, [(s.n, s.part) for s in sums], stats)

    def pass_back(self, key: tuple, asked: pa.Table, answers: pa.Table) -> pa.Table:
        """A node of a lower level: answers of its ranges' parts, for those that asked it."""
        sums = [_Sums(asked, kind) for kind in _KINDS]
        whole = any(asked.column("fold").to_pylist())
        found = []
        for kind, s in zip(_KINDS, sums, strict=True):
            found.append((_joined(answers, f"{kind}_n", len(s.keys)), _joined(answers, f"{kind}_part", len(s.keys)) if whole else None))
        return self._answers(key[0].as_py(), asked, sums, found, (0, 0, 0))

    def _answers(self, node: int, asked: pa.Table, sums: list["_Sums"], found: list[tuple], stats: tuple[int, int, int]) -> pa.Table:
        rows = []
        for i, (member, fold) in enumerate(zip(asked.column("member").to_pylist(), asked.column("fold").to_pylist(), strict=True)):
            row: list = [member, node % self.fan]
            for s, (n, part) in zip(sums, found, strict=True):
                row += [pack(n[s.places(i)]), pack(part[s.places(i)]) if fold else None]
            rows.append((*row, *(stats if i == 0 else (0, 0, 0))))
        return _table(rows, _ANSWER)


class _Sums:
    """Keys of all messages to a node, their summed counts, and each message's places among them."""

    def __init__(self, asked: pa.Table, kind: str):
        keys = [_unpack_keys(x.as_py()) for x in asked.column(f"{kind}_keys")]
        self.keys, self._place = np.unique(np.concatenate(keys), return_inverse=True)
        self._ends = np.cumsum([0, *map(len, keys)])
        self.n, self.part = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.uint64)
        for name, total in (("n", self.n), ("part", self.part)):
            for i, x in enumerate(asked.column(f"{kind}_{name}")):
                if x.as_py():
                    total[self.places(i)] += unpack(x.as_py())  # a message's keys are distinct

    def places(self, i: int) -> np.ndarray:
        return self._place[self._ends[i] : self._ends[i + 1]]


def _joined(answers: pa.Table, column: str, size: int) -> np.ndarray:
    """Counts of a sender's keys, in their order, from the answers of all ranges."""
    order = np.argsort(answers.column("digit").to_numpy())
    parts = [unpack(answers.column(column)[int(k)].as_py() or b"") for k in order]
    out = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if len(out) != size:
        raise ValueError("the answers don't fit the block: its rows differ from those that asked")
    return out


def _counts(b: _Block, answers: pa.Table, suffix: str) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of a block's words and pairs, in the block's order."""
    words, pairs = (_joined(answers, f"{kind}_{suffix}", len(keys)) for kind, keys in zip(_KINDS, (b.words, b.pairs), strict=True))
    return words.astype(np.float64), pairs.astype(np.float64)


def exchanged(docs: DataFrame, blocks: int) -> tuple[DataFrame, tuple[int, int, int]]:
    """Answers to all blocks of ``docs``, as a table in the shared folder; distinct words, tokens, tokens in the fold."""
    x = Exchange(blocks)
    asked = [docs.groupBy("block").applyInArrow(lambda k, t: x.ask(k, t), _ASK)]
    for level in range(1, x.levels):
        asked[-1] = cut(asked[-1], "asked")  # read again on the way back
        asked.append(asked[-1].groupBy("node").applyInArrow(x.pass_on(level), _ASK))
    answers = asked.pop().groupBy("node").applyInArrow(lambda k, t: x.answer(k, t), _ANSWER)
    stats = None
    while asked:
        answers = cut(answers, "answers")
        part = answers.select("n_distinct", "n_tokens", "n_fold")
        stats = part if stats is None else stats
        answers = asked.pop().groupBy("node").cogroup(answers.groupBy("member")).applyInArrow(lambda k, t, a: x.pass_back(k, t, a), _ANSWER)
    answers = cut(answers, "answers")
    total = (answers if stats is None else stats).agg(F.sum("n_distinct"), F.sum("n_tokens"), F.sum("n_fold")).first()
    return answers, tuple(v or 0 for v in total)


def bucket_of(n: np.ndarray) -> np.ndarray:
    """Bucket of a context by how often it was seen; 0 if never."""
    return np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


_CELLS = "bucket int, q2 int, q1 int, n double, log2 double, log1 double"


def _cells(kept: float):
    """Held-out events of a block: by bucket and by both estimates, in small cells."""

    def cells(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int32() if " int" in x else pa.float64()) for x in _CELLS.split(", ")})
        b = _Block(docs)
        (words, pairs), (own_words, own_pairs) = _counts(b, answers, "n"), _counts(b, answers, "part")
        words, pairs = words - own_words, pairs - own_pairs
        seen, c1, c2 = words[b.context][b.trained], words[b.word][b.trained], pairs[b.pair][b.trained]
        p2, p1 = c2 / np.maximum(seen, 1), c1 / max(kept, 1.0)
        log2, log1 = (np.log(np.where(p > 0, p, 1)) for p in (p2, p1))
        q2 = np.where(p2 > 0, np.round(log2 * _STEP), 1).astype(np.int64)  # 1: no such pair
        q1 = np.where(p1 > 0, np.round(log1 * _STEP), 1).astype(np.int64)
        code = (bucket_of(seen) * 4096 - q2 + 1) * 4096 - q1 + 1
        cell, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, minlength=len(cell)).astype(float)
        return pa.table(
            {
                "bucket": pa.array(cell // 4096 // 4096, pa.int32()),
                "q2": pa.array(1 - cell // 4096 % 4096, pa.int32()),
                "q1": pa.array(1 - cell % 4096, pa.int32()),
                "n": n,
                "log2": np.bincount(at, weights=log2, minlength=len(cell)),
                "log1": np.bincount(at, weights=log1, minlength=len(cell)),
            }
        )

    return cells


def learn_weights(cells: np.ndarray, distinct: int) -> np.ndarray:
    """Mixture weights (bucket x [pair, word, uniform]) by expectation maximisation.

    ``cells`` has the columns bucket, q2, q1, n, log2, log1 (sums).  A bucket
    without events takes the weights of the next lower one; the pair's weight of
    bucket 0 is 0, as contexts that were never seen say nothing.
    """
    out = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    for k in range(BUCKETS):
        if k:
            out[k] = out[k - 1]
        c = cells[cells[:, 0] == k]
        if not len(c):
            continue
        n = c[:, 3]
        p = np.column_stack(
            [
                np.where(c[:, 1] > 0, 0.0, np.exp(c[:, 4] / n)),
                np.where(c[:, 2] > 0, 0.0, np.exp(c[:, 5] / n)),
                np.full(len(c), 1.0 / (distinct + 1)),
            ]
        )
        w = np.array([0.0 if k == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + np.array([0.0, 0.05, 0.05])
            w /= w.sum()
        out[k] = w
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scoring(weights: np.ndarray, distinct: int, total: int):
    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _SCORES.split(", ")]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, types, strict=True)})
        b = _Block(docs)
        words, pairs = _counts(b, answers, "n")
        seen, c1 = words[b.context], words[b.word]
        w = weights[bucket_of(seen)]
        p = w[:, 0] * pairs[b.pair] / np.maximum(seen, 1) + w[:, 1] * c1 / max(total, 1) + w[:, 2] / (distinct + 1)
        base = np.log10((c1 + ADD) / (total + ADD * (distinct + 1)))
        known = np.add.reduceat((c1 > 0).astype(np.int64), b.first)
        columns = (
            docs.column("doc_id"), docs.column("held_out"), b.tokens, known,
            np.add.reduceat(base, b.first), np.add.reduceat(np.log10(p), b.first),
        )
        return pa.table({k: c.cast(t) if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})

    return score


def lm_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Reads doc_id and text.  A null or blank text has one token, the end.  Rows
    without doc_id are learned from.  Repeated rows count as often as they
    occur.  If nothing is learned from, each token's base score is that of one
    slot in one.  An empty table gives an empty result.  ``docs`` is read more
    than once and must give its rows in the same order and splits, as files do.
    Where they differ the run stops if a block's number of keys does, but blocks
    with as many other keys would get wrong counts: write ``docs`` to a table
    first if its source may change between reads.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(crc_mod(F.col("doc_id"), HOLD_OUT) == 0, F.lit(False)).alias("held_out"),
    )
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    each = max(1, -(-size // (FOLD * BLOCK_BYTES)))  # blocks of each fold
    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLD))
    # The row's own number is mixed in, so that equal rows don't all meet in one block.
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(each)) * FOLD + fold)
    answers, (distinct, total, in_fold) = exchanged(docs, each * FOLD)

    part, own = F.col("block") % FOLD == 1, F.col("member") % FOLD == 1
    events = docs.filter(part).groupBy("block").cogroup(answers.filter(own).groupBy("member")).applyInArrow(_cells(float(total - in_fold)), _CELLS)
    cells = events.groupBy("bucket", "q2", "q1").agg(*(F.sum(c) for c in ("n", "log2", "log1"))).collect()  # a bounded grid
    weights = learn_weights(np.array([tuple(r) for r in cells], dtype=float).reshape(-1, 6), distinct)

    scored = docs.groupBy("block").cogroup(answers.groupBy("member")).applyInArrow(_scoring(weights, distinct, total), _SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
