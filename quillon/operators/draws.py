"""Draws of resamples in packed form: made by many tasks, weighted where the values are.

Places of a group are cut in parts of ``PART``.  What a task draws for one round
goes to a part as one row: how often each place was drawn, four bits a place, or
the places themselves, two bytes each, where that is shorter.  A part's values go
to the same task once for each lane of rounds.  So a draw costs a byte or two on
the way, and no task holds more than a part's values.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a part; tasks that share the rounds of a part.
PART, LANES = 1 << 16, 16
#: Draws of a round that are packed together, and bytes of packed rows that are sent at a time.  Fewer draws would
#: take more bytes each where a round has several chunks: half a byte a place is for all that fall on a part.
CHUNK, SEND = 1 << 24, 1 << 22
#: Rows of an Arrow batch, up to half a megabyte each.
ROWS = 256

PACKED = "_k string, _part long, _b long, _counted boolean, _data binary"


def _place(n: int) -> type:
    return np.uint32 if n <= 1 << 32 else np.uint64


def packed(places: np.ndarray, n: int) -> Iterator[tuple[int, bool, bytes]]:
    """``(part, counted, data)`` of places below ``n`` that were drawn for one round."""
    places = np.sort(places.astype(_place(n), copy=False))
    if not len(places):
        return
    first, last = int(places[0]) // PART, int(places[-1]) // PART
    ends = np.append(np.searchsorted(places, np.arange(first + 1, last + 1).astype(places.dtype) * places.dtype.type(PART)), len(places))
    start = 0
    for part, end in zip(range(first, last + 1), ends.tolist(), strict=True):
        at, start = (places[start:end] & places.dtype.type(PART - 1)).astype(np.uint16), end
        if not len(at):
            continue
        size = min(PART, n - part * PART)
        counts = np.bincount(at, minlength=size + size % 2) if 4 * len(at) > size else None
        if counts is not None and counts.max() < 16:
            four = counts.astype(np.uint8)
            yield part, True, (four[0::2] | four[1::2] << 4).tobytes()
        else:
            yield part, False, at.astype("<u2").tobytes()


def weighted(counted: bool, data: bytes, values: np.ndarray) -> float:
    """The sum of the values of a part at the places drawn."""
    if not counted:
        return float(values[np.frombuffer(data, "<u2")].sum())
    four = np.frombuffer(data, np.uint8)
    counts = np.empty(2 * len(four))
    counts[0::2], counts[1::2] = four & 15, four >> 4
    counts = counts[: len(values)]
    if np.isfinite(values).all():
        return float(counts @ values)
    at = np.flatnonzero(counts)  # an infinite value counts only where it is drawn
    return float(counts[at] @ values[at])


def batches(rows: Iterator[tuple[str, int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    """Packed rows (_k, _b, part, counted, data) as Arrow batches of bounded size."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        k, b, part, counted, data = zip(*held, strict=True)
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((k, part, b, counted, data), types, strict=True)], names=["_k", "_part", "_b", "_counted", "_data"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4]) + 64
        if size > SEND:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of drawn values; a part's values come before the rows of its rounds."""
    values = np.empty(0)
    for batch in parts:
        keys, rounds, sums = [], [], []
        for k, b, counted, data, own in zip(*(batch.column(c) for c in ("_k", "_b", "_counted", "_data", "_values")), strict=True):
            if own.is_valid:
                values = own.values.to_numpy(zero_copy_only=False)
            else:
                keys.append(k.as_py())
                rounds.append(b.as_py())
                sums.append(weighted(counted.as_py(), data.as_py(), values))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rounds, pa.int64()), pa.array(sums, pa.float64())], names=["_k", "_b", "_x"])


def sums_of_rounds(draws: DataFrame, values: DataFrame, tasks: int) -> DataFrame:
    """``(_k, _b, _x)``: the sum of each round's values, from packed ``draws`` and ``values`` (_k, _i, _v), places counted from 0."""
    conf = draws.sparkSession.conf
    now = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > ROWS:  # plans are lazy, so it stays; it is only ever lowered
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    part = F.floor(F.col("_i") / PART)
    arrays = values.groupBy("_k", part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).getField("_v").alias("_values"))  # PART values at most
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))
    own = arrays.select("_k", "_part", lanes.alias("_lane"), F.lit(-1).cast("long").alias("_b"), "_values")
    rows = draws.withColumn("_lane", F.pmod("_b", F.lit(LANES))).unionByName(own, allowMissingColumns=True)
    rows = rows.repartition(tasks, "_k", "_part", "_lane").sortWithinPartitions("_k", "_part", "_lane", "_b")
    rows = rows.select("_k", "_b", "_counted", "_data", "_values")
    return rows.mapInArrow(_weigh, "_k string, _b long, _x double").groupBy("_k", "_b").agg(F.sum("_x").alias("_x"))


# MD5 of many texts that differ in their last digits

_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADD = tuple(int(abs(np.sin(t + 1.0)) * 4294967296) for t in range(64))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ALL = 0xFFFFFFFF
#: Digits that vary at a time, and texts from which on arrays pay.
_WIDTH, _MANY = 4, 1000


def _low(x):
    """A number's low 32 bits; arrays of 32 bits have no others."""
    return x & _ALL if isinstance(x, int) else x


def _block(state: tuple, words: list) -> tuple:
    """MD5's state after a block of 16 words; each number is an int or an array of 32-bit ones."""
    a, b, c, d = state
    for t in range(64):
        if t < 16:
            f, g = d ^ (b & (c ^ d)), t
        elif t < 32:
            f, g = c ^ (d & (b ^ c)), (5 * t + 1) % 16
        elif t < 48:
            f, g = b ^ c ^ d, (3 * t + 5) % 16
        else:
            f, g = c ^ (b | (d ^ _ALL)), 7 * t % 16
        x, s = _low(a + f), _TURN[t // 16][t % 4]
        x = _low(x + _low(words[g] + _ADD[t]))
        a, d, c, b = d, c, b, _low(b + (_low(x << s) | (x >> (32 - s))))
    return tuple(_low(x + y) for x, y in zip(state, (a, b, c, d), strict=True))


@cache
def _digits(width: int) -> np.ndarray:
    """The digits' characters of all numbers of ``width`` digits, a row a digit."""
    n = np.arange(10**width)
    return np.array([n // 10 ** (width - 1 - j) % 10 + 48 for j in range(width)], dtype=np.uint32)


def _tails(head: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The first 60 bits of the MD5 of ``head`` and each number from ``start`` to ``stop`` in ``width`` digits."""
    if stop - start < _MANY:
        texts = (head + str(r).zfill(width).encode() for r in range(start, stop))
        return np.array([int.from_bytes(hashlib.md5(t, usedforsecurity=False).digest()[:8], "big") >> 4 for t in texts], dtype=np.int64)
    size = len(head) + width
    text = head + bytes(width) + b"\x80" + bytes((55 - size) % 64) + struct.pack("<Q", size * 8)
    words, varied = list(struct.unpack(f"<{len(text) // 4}I", text)), _digits(width)[:, start:stop]
    for j in range(width):
        at = len(head) + j
        words[at // 4] = words[at // 4] + (varied[j] << np.uint32(8 * (at % 4)))
    state = _START
    for k in range(0, len(words), 16):
        state = _block(state, words[k : k + 16])
    high, low = (x.byteswap().astype(np.int64) for x in state[:2])
    return high << 28 | low >> 4


def hashed_places(seed: int, group: str | None, round_: int, start: int, stop: int, n: int) -> np.ndarray:
    """Places below ``n`` of the positions from ``start`` to ``stop``: what ``bootstrap.hashed_draw`` says of each."""
    head, out, i = "|".join([str(seed), *([] if group is None else [group]), str(round_), ""]), np.empty(max(0, stop - start), _place(n)), start
    while i < stop:
        q, r = divmod(i, 10**_WIDTH)
        width = _WIDTH if q else len(str(i))
        end = min(stop, q * 10**_WIDTH + 10**width)
        out[i - start : end - start] = _tails((head + (str(q) if q else "")).encode(), width, r, r + end - i) % n
        i = end
    return out
