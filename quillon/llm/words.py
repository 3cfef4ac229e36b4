"""Vectorised words and word hashes of UTF-8 texts, used inside Spark tasks.

A word is a maximal run of bytes outside space and ``\\x09-\\x0D``; A-Z are
lower-cased first.  Hashes are 64 bits and depend on nothing but the bytes: the
length, then eight bytes at a time, each followed by an avalanche step, so that
no rule that holds for sums or products of bytes makes two words collide.  Where
a result rests on equality alone, callers compare the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import xxhash

_CHUNK = 1 << 20
#: Longer ranges are hashed one by one.
_LONG = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Masks of the first 0 to 8 bytes of a little-endian number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``[start, end)`` of one buffer."""
    size = end - start
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + np.uint64(1)) * _ODD)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
        while len(live):
            left = size[live] - at
            h[live] = mix(h[live] * _ODD + (eight[start[live] + at] & _MASK[np.minimum(left, 8)]))
            live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return h


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one buffer."""
    space = _IS_SPACE[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)
    return start, end, hash_slices(_FOLD[raw], start, end)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts, concatenated, and offsets (len + 1)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < _CHUNK):
            size += len(texts[j]) + 1
            j += 1
        raw = np.frombuffer(b" ".join(texts[i:j]), dtype=np.uint8)
        if len(raw):
            start, _, h = _hash_chunk(raw)
            ends = np.cumsum([len(x) + 1 for x in texts[i:j]])
            counts[i + 1 : j + 1] = np.diff(np.searchsorted(start, ends), prepend=0)
            hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of the words of one text."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return _hash_chunk(np.frombuffer(text, dtype=np.uint8))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words; of the whole if it is shorter."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(0x100000001B3) + h[k : len(h) - n + 1 + k])
    return out

