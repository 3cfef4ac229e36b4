"""Token files: ids of whole documents in seekable zstandard shards.

Documents are dealt by range of doc_id and sorted, so shard k holds smaller ids
than shard k+1 and each shard is written by one task, frame after frame.  A
frame holds whole documents; the index of a shard lists doc_id, frame and
length of each.  The shards' totals (one row a shard) give every document its
place in the whole sequence.

Encoding goes through the tokenizers library.  A space before a character that
isn't white space always begins a new piece of the byte-level pre-tokenizer, so
a text can be encoded slice by slice at such spaces with the same ids; each
distinct slice of a worker is encoded once; slices are looked up by hash, and
their bytes are compared.  An added token such as
<|endoftext|> ends a piece wherever it stands, so a text that holds one is
encoded whole.
"""

from __future__ import annotations

import ctypes
import weakref
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import scratch_path, small_batches
from .words import hash_slices

END_ID = 0
#: Ids after which a frame is closed; a longer document fills a frame alone.
FRAME_IDS = 1 << 16
#: Distinct slices that a worker keeps; beyond it starts anew.
CACHE_SLICES = 3_000_000
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 1 << 21
#: Bytes of text of an average shard, if that makes more shards than there are shuffle partitions.
SHARD_BYTES = 1 << 27

#: A space starts no slice before these bytes: ASCII white space and the lead
#: bytes of other Unicode white space.
_GLUED = np.zeros(256, dtype=bool)
_GLUED[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``lo .. lo + n``, one after the other."""
    before = np.cumsum(n) - n
    return np.repeat(lo - before, n) + np.arange(n.sum())


def _appended(pool: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``pool`` with ``new`` from place ``used`` on, in a larger array if need be."""
    while used + len(new) > len(pool):
        pool = np.concatenate([pool, np.empty_like(pool)])
    pool[used : used + len(new)] = new
    return pool


def _same(a: np.ndarray, a_lo: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> bool:
    """Whether the ranges of ``a`` hold the same bytes as those of ``b``."""
    return np.array_equal(a_n, b_n) and np.array_equal(a[_ranges(a_lo, a_n)], b[_ranges(b_lo, b_n)])


class Encoder:
    """Ids of many texts at a time, equal to the tokenizer's own."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocab = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self._bytes[i] = len(token)  # a character stands for a byte
        self._forget()

    def _forget(self) -> None:
        self._keys = np.empty(0, dtype=np.uint64)  # ascending
        self._lo = np.empty(0, dtype=np.int64)
        self._n = np.empty(0, dtype=np.int64)
        self._pool = np.empty(1 << 20, dtype=np.uint32)
        self._used = 0
        self._text_lo = np.empty(0, dtype=np.int64)
        self._text_n = np.empty(0, dtype=np.int64)
        self._text = np.empty(1 << 20, dtype=np.uint8)  # the slices' bytes
        self._text_used = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Encode new slices ``raw[lo:hi]``; those that begin with a space as one text."""
        free = (hi - lo > 1) & (raw[lo] == 0x20) & ~_GLUED[raw[np.minimum(lo + 1, len(raw) - 1)]]
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        size = (hi - lo)[order]
        parts, counts = [], []
        for i in range(0, int(free.sum()), 50_000):
            k = order[: free.sum()][i : i + 50_000]
            ids = self._ids(raw[_ranges(lo[k], (hi - lo)[k])].tobytes().decode("utf-8"))
            ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(size[i : i + len(k)])) + 1
            parts.append(ids)
            counts.append(np.diff(ends, prepend=0))
        for k in order[free.sum() :]:
            ids = self._ids(raw[lo[k] : hi[k]].tobytes().decode("utf-8"))
            parts.append(ids)
            counts.append([len(ids)])
        ids, n = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        self._pool, start = _appended(self._pool, self._used, ids), self._used + np.cumsum(n) - n
        self._used += len(ids)
        back = np.argsort(order)
        at = np.searchsorted(self._keys, keys)
        self._lo = np.insert(self._lo, at, start[back])
        self._n = np.insert(self._n, at, n[back])
        size = hi - lo
        self._text = _appended(self._text, self._text_used, raw[_ranges(lo, size)])
        self._text_lo = np.insert(self._text_lo, at, self._text_used + np.cumsum(size) - size)
        self._text_n = np.insert(self._text_n, at, size)
        self._text_used += int(size.sum())
        self._keys = np.insert(self._keys, at, keys)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        whole = [any(a in t for a in self._added) for t in texts]
        sliced = iter(self._by_slices([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [self._ids(t.decode("utf-8")) if w else next(sliced) for t, w in zip(texts, whole, strict=True)]

    def _by_slices(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
                size += len(texts[j])
                j += 1
            out += self._encode(texts[i:j])
            i = j
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts]
        if not len(raw):
            return [np.empty(0, np.uint32)] * len(texts)
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[:-2] = (raw[:-1] == 0x20) & ~_GLUED[raw[1:]]
        cut[starts] = True  # of an empty text: the next one's start, or the end
        cut[-1] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(raw))
        size = end - begin
        keys, first, inverse = np.unique(hash_slices(raw, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        new = at == len(self._keys)
        new[~new] = self._keys[at[~new]] != keys[~new]
        old, place = first[~new], at[~new]
        if not (
            _same(raw, begin[first][inverse], size[first][inverse], raw, begin, size)
            and _same(self._text, self._text_lo[place], self._text_n[place], raw, begin[old], size[old])
        ):
            return [self._ids(t.decode("utf-8")) for t in texts]  # different slices of one hash
        if len(self._keys) + new.sum() > CACHE_SLICES:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(keys[new], raw, begin[first[new]], end[first[new]])
            at = np.searchsorted(self._keys, keys)
        n = self._n[at][inverse]
        ids = self._pool[_ranges(self._lo[at][inverse], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        first_of = total[np.searchsorted(begin, starts)]
        last_of = total[np.searchsorted(begin, ends)]
        return [ids[a:b] for a, b in zip(first_of, last_of, strict=True)]


def _utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; what isn't UTF-8 becomes replacement characters."""
    out = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer: Broadcast) -> Encoder:
    """The worker's encoder of a tokenizer, with the slices that it knows.

    It goes with the broadcast, which Spark takes from a worker with the first
    task that doesn't use it: workers live on, and later stages need the memory.
    """
    key = id(tokenizer)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer.value)
        weakref.finalize(tokenizer, _drop, key)
    return _ENCODERS[key]


def _drop(key: int) -> None:
    _ENCODERS.pop(key, None)
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed otherwise
        trim(0)


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:06d}.zst"


_WRITTEN = "shard int, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, shards: int | None = None) -> DataFrame:
    """Encode every row of ``docs`` into shards in ``folder``; one row a shard.

    Reads doc_id and text.  A null text is the empty one; each document ends
    with id ``END_ID``.  Rows are in ascending doc_id order (null first, equal
    doc_ids by text), so repeated rows are written as often as they occur.  An
    empty table writes no documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        out, encoder = None, _encoder(tokenizer)
        held: list[np.ndarray] = []
        rows: list[tuple[int, int, int, int]] = []
        total, waiting = 0, 0
        end = np.array([END_ID], dtype=np.uint32)

        def flush() -> None:
            nonlocal held, waiting
            if held:
                out.frame(np.concatenate(held).astype("<u4").tobytes())
                held, waiting = [], 0

        frame = 0
        for batch in batches:
            out = out or seekable.Writer(shard_uri(folder, shard))
            ids = encoder.encode(_utf8(batch.column("text")))
            for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                if waiting and waiting + len(x) + 1 > FRAME_IDS:
                    flush()
                    frame += 1
                held += [x, end]
                waiting += len(x) + 1
                rows.append((doc or 0, doc is None, frame, len(x) + 1))
                total += len(x) + 1
        if out is not None:
            flush()
            columns = zip(*rows, strict=True)
            out.close(seekable.join_index([np.array(c, dtype="<i8").tobytes() for c in columns]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(rows)]), pa.array([total])], names=["shard", "n_docs", "n_tokens"])

    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = dealt.mapInArrow(write, _WRITTEN).collect()  # a row a shard; the files are the data
    return spark.createDataFrame(sorted(written), _WRITTEN)


def read_shard(uri: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard's documents, or only of the wanted ones.

    Frames without a wanted document are neither read nor decompressed.
    """
    reader = seekable.Reader(uri)
    try:
        doc, null, frame, n = (np.frombuffer(x, dtype="<i8") for x in seekable.split_index(reader.index))
        bounds = np.searchsorted(frame, np.arange(reader.frames + 1))
        for k in range(reader.frames):
            a, b = bounds[k], bounds[k + 1]
            if wanted is not None and not wanted.intersection(doc[a:b].tolist()):
                continue
            ids, at = np.frombuffer(reader.frame(k), dtype="<u4"), 0
            for i in range(a, b):
                if wanted is None or int(doc[i]) in wanted and not null[i]:
                    yield (None if null[i] else int(doc[i])), ids[at : at + n[i]]
                at += n[i]
    finally:
        reader.close()


def read_tokens(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    shards, start = [], 0
    for r in sorted(written.collect()):  # a row a shard
        shards.append((r["shard"], start))
        start += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, begin, n, crc = [], [], [], []
                for d, ids in read_shard(shard_uri(folder, shard)):
                    doc.append(d)
                    begin.append(at)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (doc, begin, n, crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    table = spark.createDataFrame(shards, "shard int, start long").repartition(max(1, len(shards)), "shard")
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return their table of contents, read back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer_path))
