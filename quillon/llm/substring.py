"""Exact substring deduplication by relative Lempel-Ziv parsing against reference blocks.

A window is ``WINDOW`` consecutive words; a word goes if a window over it also
starts in a document with a smaller doc_id.

1. Documents are packed into blocks (words joined by one space, compressed),
   written once; every later pass reads these.
2. Consecutive windows that have the same least ``ANCHOR``-word hash form a
   segment, named by that hash, its anchor.  Equal windows have equal anchors, so
   the anchor alone tells in which reference block a segment's windows can occur:
   a document is parsed against every block that could hold a part of it, and
   no two documents are compared with each other.
3. Each block of documents asks which of its anchors other blocks have too: four
   bytes an anchor go out, two bits come back.  Segments of other anchors hold
   nothing that repeats.  An anchor that more than ``HOT`` blocks have is split:
   its windows are segments of their own, named by the hashes of whole windows.
4. The words of the remaining segments go to their reference blocks.  There
   segments are taken in the order of their documents and factored greedily
   against the indexed ones before them: a factor is the longest match from a
   word on, and counts from ``WINDOW`` words on.  The windows that cross the end
   of a factor are looked up next.  What no earlier segment holds is indexed.
   Matches are compared word by word, as bytes; hashes only name places.
5. The first document of every window comes back to the documents' blocks; words
   under windows of earlier documents go.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import grams, word_spans

WINDOW, ANCHOR = 13, 5
#: Bytes of text of a block of documents (a longer document is a block alone).
BLOCK_BYTES = 4 << 20
#: Bytes of text whose anchors one reference block gets.
REFERENCE_BYTES = 8 << 20
#: Blocks of documents with an anchor beyond which its segments are split.
HOT = 2048

_BLOCK = "block string, ids array<long>, sizes array<long>, body binary"


def _block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    body = zstandard.ZstdCompressor(level=3).compress(b"".join(t + b" " for t in texts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([uuid.uuid4().hex]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            pa.array([body], pa.binary()),
        ],
        names=["block", "ids", "sizes", "body"],
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks of normalised texts."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
            words = b" ".join((text.as_py() or b"").split())  # splits at space and \x09-\x0D, as the word definition
            if texts and size + len(words) > BLOCK_BYTES:
                yield _block(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(words)
            size += len(words) + 1
    if texts:
        yield _block(ids, texts)


class Segments:
    """Words, windows and segments of one block of documents."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.ends = np.cumsum(np.array(row["sizes"], np.int64) + 1)
        self.body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(self.ends[-1]))
        self.start, self.end, self.hash = word_spans(self.body)
        self.doc = np.searchsorted(self.ends, self.start, side="right")  # of each word
        known = np.array([x is not None for x in self.ids])
        self.id = np.array([x or 0 for x in self.ids], np.int64)
        m = max(len(self.hash) - WINDOW + 1, 0)
        if m:
            g = grams(self.hash, ANCHOR)
            least, at = g[:m].copy(), np.arange(m)
            for k in range(1, WINDOW - ANCHOR + 1):
                here = g[k : k + m]
                less = here < least
                least, at = np.where(less, here, least), np.where(less, np.arange(k, k + m), at)
            whole = (self.doc[:m] == self.doc[WINDOW - 1 :]) & known[self.doc[:m]]
            windows = np.flatnonzero(whole)
        else:
            least, at, windows = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        new = np.flatnonzero(np.diff(at[windows], prepend=-1))
        self.first = windows[new]  # first window of each segment
        self.n = np.diff(np.append(new, len(windows)))  # its windows
        self.anchor = least[self.first]
        self.of = self.doc[self.first]

    def split(self, hot: np.ndarray) -> None:
        """Make each window of the segments ``hot`` (a mask) a segment, named by the hash of all its words."""
        if hot.any():
            n = self.n[hot]
            single = np.repeat(self.first[hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            names = grams(self.hash, WINDOW)[single]
            self.first = np.concatenate([self.first[~hot], single])
            self.n = np.concatenate([self.n[~hot], np.ones(len(single), np.int64)])
            self.anchor = np.concatenate([self.anchor[~hot], names])
            self.of = self.doc[self.first]

    def text(self, i: int) -> bytes:
        """Words of segment ``i``."""
        return self.body[self.start[self.first[i]] : self.end[self.first[i] + self.n[i] + WINDOW - 2]]


def _place(anchor: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Reference block of each anchor, and its 32-bit key there."""
    high = (anchor >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    return high.astype(np.int64), anchor.astype(np.uint32)


def _anchors(s: Segments, blocks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By reference block: distinct keys, ascending, and whether two documents of the block have them."""
    place, key = _place(s.anchor, blocks)
    code, back = np.unique(place.astype(np.uint64) << np.uint64(32) | key, return_inverse=True)
    low, high = np.full(len(code), len(s.ids)), np.full(len(code), -1)
    np.minimum.at(low, back, s.of)
    np.maximum.at(high, back, s.of)
    of = (code >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return {
        int(of[a]): (code[a:b].astype(np.uint32), low[a:b] < high[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(of)), strict=True)
    }


_ASK = "place long, block string, keys binary"


def _ask(blocks: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                found = _anchors(Segments(row), blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.int64()),
                        pa.array([row["block"]] * len(found), pa.string()),
                        pa.array([keys.tobytes() for keys, _ in found.values()], pa.binary()),
                    ],
                    names=["place", "block", "keys"],
                )

    return ask


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_BITS = "block string, place long, sum long, shared binary, hot binary"


def _recurring(hot: int):
    def recurring(key: tuple, asked: pa.Table) -> pa.Table:
        """Bits for the keys of each block: do others have it, and very many?"""
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in asked.column("keys")]
        known, n = np.unique(np.concatenate(keys), return_counts=True)
        seen = [n[np.searchsorted(known, k)] for k in keys]
        return pa.table(
            {
                "block": asked.column("block"),
                "place": asked.column("place"),
                "sum": pa.array([zlib.crc32(k.tobytes()) for k in keys], pa.int64()),
                "shared": pa.array([np.packbits(x > 1).tobytes() for x in seen], pa.binary()),
                "hot": pa.array([np.packbits(x > hot).tobytes() for x in seen], pa.binary()),
            }
        )

    return recurring


def _candidates(row: dict, blocks: int) -> tuple[Segments, dict[int, tuple[dict[bytes, list[int]], np.ndarray]]]:
    """Segments of a block's recurring anchors: by reference block, texts with their segments, and the texts' keys."""
    s = Segments(row)
    bits = {x["place"]: x for x in row["bits"]}
    codes, hot = [], []
    for place, (keys, several) in _anchors(s, blocks).items():
        x = bits[place]
        if zlib.crc32(keys.tobytes()) != x["sum"]:
            raise ValueError("the answer is not for these anchors: the block changed since it asked")
        shared, many = (np.unpackbits(np.frombuffer(x[c], np.uint8), count=len(keys)).astype(bool) for c in ("shared", "hot"))
        codes.append((np.uint64(place) << np.uint64(32) | keys)[shared | several])
        hot.append((np.uint64(place) << np.uint64(32) | keys)[many])
    place, key = _place(s.anchor, blocks)
    code = place.astype(np.uint64) << np.uint64(32) | key
    live = np.isin(code, np.concatenate(codes)) if codes else np.zeros(len(code), bool)
    hot = np.isin(code, np.concatenate(hot)) if hot else live
    s.first, s.n, s.anchor, s.of, hot = (x[live] for x in (s.first, s.n, s.anchor, s.of, hot))
    s.split(hot)
    place, key = _place(s.anchor, blocks)
    out: dict[int, tuple[dict[bytes, list[int]], list[int]]] = {}
    for i, p in enumerate(place.tolist()):
        texts, keys = out.setdefault(p, ({}, []))
        text = s.text(i)
        if text in texts:
            texts[text].append(i)
        else:
            texts[text] = [i]
            keys.append(key[i])
    return s, {p: (texts, np.array(keys, np.uint32)) for p, (texts, keys) in out.items()}


_SEND = "place long, block string, keys binary, docs binary, sizes binary, texts binary"


def _send(blocks: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in _rows(batch):
                s, found = _candidates(row, blocks)
                docs = [np.array([s.id[s.of[own]].min() for own in texts.values()], np.int64) for texts, _ in found.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.int64()),
                        pa.array([row["block"]] * len(found), pa.string()),
                        pa.array([keys.tobytes() for _, keys in found.values()], pa.binary()),
                        pa.array([d.tobytes() for d in docs], pa.binary()),
                        pa.array([np.array([len(t) for t in texts], np.int64).tobytes() for texts, _ in found.values()], pa.binary()),
                        pa.array([pack.compress(b"".join(texts)) for texts, _ in found.values()], pa.binary()),
                    ],
                    names=[x.split()[0] for x in _SEND.split(", ")],
                )

    return send


class Reference:
    """Segments of one anchor in the order of their documents, indexed by the windows that begin in them."""

    def __init__(self):
        self.words: list[list[bytes]] = []
        self.index: dict[tuple, tuple[int, int, int]] = {}  # window -> (first document, segment, word)

    def parse(self, words: list[bytes], doc: int) -> list[int]:
        """First document of each window of a segment, by greedy factors; windows without a match are indexed."""
        m = len(words) - WINDOW + 1
        first, i = [doc] * m, 0
        self.words.append(words)
        while i < m:
            seed = tuple(words[i : i + WINDOW])
            found = self.index.get(seed)
            if found is None:
                self.index[seed] = (doc, len(self.words) - 1, i)
                i += 1
                continue
            of, k, at = found
            source, length = self.words[k], WINDOW
            while i + length < len(words) and at + length < len(source) and words[i + length] == source[at + length]:
                seed = tuple(words[i + length - WINDOW + 1 : i + length + 1])
                if self.index.get(seed, found)[0] < of:
                    break  # an even earlier document has the window that begins here: another factor
                length += 1
            for j in range(i, i + length - WINDOW + 1):
                first[j] = of
            i += length - WINDOW + 1  # the first window that crosses the factor's end
        return first


_FOUND = "block string, place long, first binary"


def _parse(key: tuple, sent: pa.Table) -> pa.Table:
    """First documents of all windows that the messages of one reference block name."""
    own: list[list[bytes]] = []
    first_of: dict[bytes, int] = {}
    anchors: dict[int, dict[bytes, None]] = {}
    unpack = zstandard.ZstdDecompressor()
    for keys, docs, sizes, texts in zip(*(sent.column(c) for c in ("keys", "docs", "sizes", "texts")), strict=True):
        ends = np.cumsum(np.frombuffer(sizes.as_py(), np.int64)).tolist()
        body = unpack.decompress(texts.as_py(), max_output_size=ends[-1])
        here, a = [], 0
        for b, k, doc in zip(ends, np.frombuffer(keys.as_py(), np.uint32).tolist(), np.frombuffer(docs.as_py(), np.int64).tolist(), strict=True):
            text, a = body[a:b], b
            if text not in first_of:
                first_of[text] = doc
                anchors.setdefault(k, {})[text] = None
            elif doc < first_of[text]:
                first_of[text] = doc
            here.append(text)
        own.append(here)
    found: dict[bytes, bytes] = {}
    for texts in anchors.values():
        if len(texts) == 1:  # one segment, in one document or in many: a single factor for all but the first
            (text,) = texts
            found[text] = np.full(text.count(b" ") + 2 - WINDOW, first_of[text], np.int64).tobytes()
            continue
        reference = Reference()
        for text in sorted(texts, key=first_of.__getitem__):
            found[text] = np.array(reference.parse(text.split(b" "), first_of[text]), np.int64).tobytes()
    pack = zstandard.ZstdCompressor(level=1)
    return pa.table(
        {
            "block": sent.column("block"),
            "place": sent.column("place"),
            "first": pa.array([pack.compress(b"".join(map(found.__getitem__, here))) for here in own], pa.binary()),
        }
    )


_ROWS = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(blocks: int, text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in _rows(batch):
                s, found = _candidates(row, blocks)
                hits = [np.empty(0, np.int64)]
                answers = {x["place"]: x["first"] for x in row["found"] or []}
                for place, (texts, _) in found.items():
                    first, at = np.frombuffer(unpack.decompress(answers[place]), np.int64), 0
                    for own in texts.values():
                        n = int(s.n[own[0]])
                        earlier = first[at : at + n]
                        hits += [s.first[i] + np.flatnonzero(earlier < s.id[s.of[i]]) for i in own]
                        at += n
                hit = np.concatenate(hits)
                edge = np.bincount(hit, minlength=len(s.hash) + 1) - np.bincount(hit + WINDOW, minlength=len(s.hash) + 1)
                yield _kept(s, np.cumsum(edge)[:-1] > 0, text)

    return remove


def _kept(s: Segments, gone: np.ndarray, text: bool) -> pa.RecordBatch:
    """A block's documents without the words that are gone."""
    docs = len(s.ids)
    begin = np.concatenate([[0], s.ends[:-1]])
    n, removed = np.bincount(s.doc, minlength=docs), np.bincount(s.doc[gone], minlength=docs)
    word = np.concatenate([[0], np.cumsum(n)])
    kept = []
    for d in range(docs):
        if removed[d]:
            a, b = word[d], word[d + 1]
            stay = np.diff(~gone[a:b], prepend=False, append=False)
            runs = np.flatnonzero(stay).reshape(-1, 2) + a
            kept.append(b" ".join(s.body[s.start[x] : s.end[y - 1]] for x, y in runs.tolist()))
        else:
            kept.append(s.body[begin[d] : s.ends[d] - 1])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(s.ids, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in kept]),
            pa.array([t if text else None for t in kept], pa.binary()).cast(pa.string()),
        ],
        names=[x.split()[0] for x in _ROWS.split(", ")],
    )


def deduplicated(docs: DataFrame, hot: int = HOT, text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for every row of ``docs``.

    ``kept`` are the words that stay, joined by one space (null if ``text`` is
    off).  Reads doc_id and text; other columns may be there.  A null text has no
    words.  Rows without doc_id keep all words and count as nobody's earlier
    document; rows of one doc_id are not earlier than each other, however often
    they repeat.  Documents of fewer than ``WINDOW`` words have no window.  An
    empty table gives an empty result.
    """
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_packed, _BLOCK)
    packed = cut(packed, "blocks")
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    blocks = max(16, -(-size // REFERENCE_BYTES))
    bits = packed.mapInArrow(_ask(blocks), _ASK).groupBy("place").applyInArrow(_recurring(hot), _BITS)
    bits = bits.groupBy("block").agg(F.collect_list(F.struct("place", "sum", "shared", "hot")).alias("bits"))  # two bits an anchor of one block
    asked = packed.join(cut(bits, "bits"), "block", "left")
    asked = asked.withColumn("bits", F.coalesce("bits", F.array().cast(asked.schema["bits"].dataType)))
    found = asked.mapInArrow(_send(blocks), _SEND).groupBy("place").applyInArrow(_parse, _FOUND)
    found = found.groupBy("block").agg(F.collect_list(F.struct("place", "first")).alias("found"))
    return asked.join(cut(found, "found"), "block", "left").mapInArrow(_remove(blocks, text), _ROWS)
