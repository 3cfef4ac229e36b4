"""WARC records of pages in seekable zstandard bundles.

Each task writes one bundle: records are grouped into independent frames, a
seek table ends the file, and the bundle's index maps record identifiers to
(frame, offset in the frame's content, length).  Of equal payloads of at least
``MIN_REVISIT`` bytes one record is the response and the others are revisits
without payload, which name it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import cut, scratch_path, small_batches

#: Smaller payloads are always stored.
MIN_REVISIT = 100
#: Bytes of records after which a frame is closed.
FRAME_BYTES = 1 << 19
_DATE = "1970-01-01T00:00:00Z"  # fixed, so that reruns write equal bytes


def record_uri(page_id: int | None) -> str:
    return f"urn:quillon:page:{'none' if page_id is None else page_id}"


def _page_of(uri: str) -> int | None:
    tail = uri.rstrip(">").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit of ``refers_to`` has an empty block.

    The block of a response is an HTTP message, as its content type says; the
    payload and its digest begin after the message's head.
    """
    revisit = refers_to is not None
    clean = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_uri(page_id)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_uri(refers_to)}>",
        ]
        block = b""
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def bundle_uri(folder: str, part: int) -> str:
    return f"{folder}/pages-{part:06d}.warc.zst"


_WRITTEN = "part int, n_records long"


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; one row a bundle.

    A null html is an empty payload.  The response of a group of equal payloads
    is the row of the smallest page_id (rows that repeat it are responses too);
    rows without page_id are always responses.  Which rows are revisits is
    found out on digests alone; payloads then move once, by page_id and digest,
    so that equal payloads never meet in one task.
    """
    spark = pages.sparkSession
    small_batches(spark, 128)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter((F.length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = (
        large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter("first <> last").select("digest", "first")
    )
    again = large.distinct().join(firsts, "digest").filter("page_id <> first")
    again = cut(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")), "revisits")
    known = rows.filter("page_id is not null")
    known = known.join(again, (known.page_id == again.p) & (known.digest == again.d), "left")
    columns = ["page_id", "url", "payload", "digest", "refers_to"]
    rows = known.select(columns).unionByName(rows.filter("page_id is null").withColumn("refers_to", F.lit(None).cast("long")).select(columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        held: list[bytes] = []
        size, frame, count = 0, 0, 0
        index: list[tuple[str, int, int, int]] = []
        for batch in batches:
            for page, url, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or seekable.Writer(bundle_uri(folder, part))
                record = make_record(page, url, payload, digest, to)
                if held and size + len(record) > FRAME_BYTES:
                    out.frame(b"".join(held))
                    held, size, frame = [], 0, frame + 1
                index.append((record_uri(page), frame, size, len(record)))
                held.append(record)
                size += len(record)
                count += 1
        if out is not None:
            out.frame(b"".join(held))
            uris, *places = zip(*index, strict=True)
            out.close(seekable.join_index([json.dumps(uris).encode(), *(np.array(x, dtype="<i8").tobytes() for x in places)]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count])], names=["part", "n_records"])

    written = rows.mapInArrow(write, _WRITTEN).collect()  # a row a bundle; the files are the data
    return spark.createDataFrame(sorted(written), _WRITTEN)


def read_bundle(uri: str, wanted: set[str] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of a bundle's records, or only of the wanted identifiers.

    Frames without a wanted record are neither read nor decompressed.
    """
    reader = seekable.Reader(uri)
    try:
        names, *places = seekable.split_index(reader.index)
        frame, at, size = (np.frombuffer(x, dtype="<i8").tolist() for x in places)
        loaded, content = -1, b""
        for name, k, a, n in zip(json.loads(names), frame, at, size, strict=True):
            if wanted is None or name in wanted:
                if k != loaded:
                    loaded, content = k, reader.frame(k)
                yield parse_record(content[a : a + n])
    finally:
        reader.close()


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """One row a record, from the bundles; a stored payload's digest is verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                rows = []
                for head, block in read_bundle(bundle_uri(folder, part)):
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                    to = None
                    if head["warc-type"] == "revisit":
                        to = _page_of(head["warc-refers-to"])
                    elif len(block) != size or hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{head['warc-record-id']}: payload differs from its digest")
                    rows.append((_page_of(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], to))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    parts = written.select("part")
    return parts.repartition(max(1, parts.count()), "part").mapInArrow(read, _READ)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the bundles of ``pages`` and return their records, read back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, folder, write_warc(pages, folder))
