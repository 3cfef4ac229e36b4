"""Seekable zstandard files: independent frames, then a seek table.

Layout (the public seekable format, all numbers little-endian)::

    frame 0 .. frame n-1        independent zstandard frames
    index                       skippable frame 0x184D2A50, zstandard inside
    seek table                  skippable frame 0x184D2A5E: per frame compressed
                                size, content size, low 32 bits of its XXH64;
                                then frame count, flags, magic 0x8F92EAB1

The index names what lies where in the frames; its content is the caller's.  A
reader takes the tail of the file, then only the frames that it needs, and
verifies each frame's checksum.
"""

from __future__ import annotations

import io
import os
import struct
import uuid

import pyarrow.fs as pafs
import xxhash
import zstandard

_INDEX = 0x184D2A50
_TABLE = 0x184D2A5E
_MAGIC = 0x8F92EAB1


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file:, hdfs:, s3: ..., or a bare path)."""
    if ":" not in uri.split("/", 1)[0]:
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; it appears under its name only when it is whole.

    A retried or speculative task writes to a name of its own and moves the
    same content over, so no attempt spoils another.
    """

    def __init__(self, uri: str, level: int = 3):
        self._fs, self._path = open_store(uri)
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._temp)
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._table: list[tuple[int, int, int]] = []

    def frame(self, content: bytes) -> int:
        """Append a frame; returns its number."""
        data = self._zstd.compress(content)
        self._out.write(data)
        self._table.append((len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return len(self._table) - 1

    def close(self, index: bytes) -> None:
        packed = self._zstd.compress(index)
        self._out.write(struct.pack("<II", _INDEX, len(packed)) + packed)
        self._table.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(struct.pack("<III", *x) for x in self._table) + struct.pack("<IBI", len(self._table), 0x80, _MAGIC)
        self._out.write(struct.pack("<II", _TABLE, len(body)) + body)
        self._out.close()
        self._fs.move(self._temp, self._path)


class Reader:
    """Reads the index at once and frames on demand."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self._in = fs.open_input_file(path)
        size = self._in.size()
        count, flags, magic = struct.unpack("<IBI", self._in.read_at(9, size - 9))
        if magic != _MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums at its end")
        raw = self._in.read_at(12 * count, size - 9 - 12 * count)
        self._table = list(struct.iter_unpack("<III", raw))
        self._at = [0]
        for packed, _, _ in self._table:
            self._at.append(self._at[-1] + packed)
        self._zstd = zstandard.ZstdDecompressor()
        packed = self._in.read_at(self._table[-1][0], self._at[-2])
        self.index = self._zstd.decompress(packed[8:])
        self.frames = count - 1

    def frame(self, k: int) -> bytes:
        """Content of frame ``k``, verified."""
        packed, size, checksum = self._table[k]
        data = self._zstd.decompress(self._in.read_at(packed, self._at[k]), max_output_size=size) if size else b""
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: checksum differs")
        return data

    def close(self) -> None:
        self._in.close()


def join_index(parts: list[bytes]) -> bytes:
    """Byte strings as one index, each behind its length."""
    out = io.BytesIO()
    for p in parts:
        out.write(struct.pack("<Q", len(p)) + p)
    return out.getvalue()


def split_index(index: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(index):
        (n,) = struct.unpack_from("<Q", index, at)
        out.append(index[at + 8 : at + 8 + n])
        at += 8 + n
    return out
