"""A sink that writes each row as a file of its own name, all of them or none, and a reader of such files.

``df.write.format("named_files").option("path", folder).mode("append").save()``
takes rows (name, text).  Tasks write to a staging folder of their attempt; only
when all tasks are done does the job move what they finished into the folder.  So
a failed task, a second attempt or a job that is stopped leaves no file, and files
of one job appear together.  With the option ``spread`` the files are dealt into
``SPREAD`` subfolders by their names; where no other task had one of the same
subfolder, it is moved as a whole.

Spark's own file sources hold every file's status on the driver, some kilobytes
for each scan.  :func:`listed` and :func:`texts` list and read in tasks.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..scratch import written

#: Subfolders that files are dealt into, and how their names begin.
SPREAD, _PART = 256, "named-"
#: Entries of a folder, and characters of text, that a task hands on in one go.
_ENTRIES, _CHARS = 4096, 4 << 20


def _store(folder: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))


@dataclass
class Staged(WriterCommitMessage):
    """Where a task left its files, and how many."""

    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, spread: bool = False):
        self._folder, self._spread, self._job = folder, spread, uuid.uuid4().hex

    def _staging(self) -> tuple:
        store, path = _store(self._folder)
        return store, path, f"{path}/_staging-{self._job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        """Write a task's rows to the folder of this attempt; of rows of one name the last stays."""
        store, _, staging = self._staging()
        own, names, parts = f"{staging}/{uuid.uuid4().hex}", set(), set()
        store.create_dir(own, recursive=True)
        for row in rows:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            to = own
            if self._spread:
                to = f"{own}/{_PART}{zlib.crc32(row['name'].encode()) % SPREAD:02x}"
                if to not in parts:
                    store.create_dir(to)
                    parts.add(to)
            with store.open_output_stream(f"{to}/{row['name']}") as out:
                out.write((row["text"] or "").encode())
            names.add(row["name"])
        return Staged(own, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of the attempts that count; the others go with the staging folder."""
        from pyarrow import fs

        store, path, staging = self._staging()
        store.create_dir(path, recursive=True)
        for m in messages:
            for f in store.get_file_info(fs.FileSelector(m.folder)) if m is not None else ():
                to = f"{path}/{f.base_name}"
                if f.type == fs.FileType.Directory and store.get_file_info(to).type != fs.FileType.NotFound:
                    for x in store.get_file_info(fs.FileSelector(f.path)):
                        store.move(x.path, f"{to}/{x.base_name}")
                else:
                    store.move(f.path, to)
        self._clear(store, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staging = self._staging()
        self._clear(store, staging)

    @staticmethod
    def _clear(store, staging: str) -> None:
        from pyarrow import fs

        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class NamedFiles(DataSource):
    """The data source ``named_files``: rows (name, text) to files in ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named files are added, never replaced as a whole: use mode append")
        return NamedFilesWriter(self.options["path"], self.options.get("spread", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make ``named_files`` known to a session."""
    spark.dataSource.register(NamedFiles)


def part(name: str) -> Column:
    """The subfolder's number of a file name, as the sink deals it."""
    return F.crc32(F.col(name).cast("binary")) % SPREAD


def reachable(folder: str) -> bool:
    """Whether tasks can open this folder themselves; some stores only Spark's own sources can read."""
    try:
        return bool(_store(folder))
    except (pa.ArrowException, OSError):
        return False


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            store, path = _store(folder)
            found = store.get_file_info(fs.FileSelector(path))
            for k in range(0, len(found), _ENTRIES):
                some = found[k : k + _ENTRIES]
                yield pa.RecordBatch.from_pydict({"folder": [folder] * len(some), "name": [f.base_name for f in some], "inner": [f.type == fs.FileType.Directory for f in some]})


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, folder)`` of the files in a folder, spread ones included; listed once, by tasks.

    The folder itself is one task's list, each subfolder another's.  If a name is in both, the one in the subfolder counts.
    """
    kind, folder = "folder string, name string, inner boolean", folder.rstrip("/")
    top = written(spark.createDataFrame([(folder,)], "folder string").mapInArrow(_entries, kind), "entries")
    inner = top.filter(F.col("inner") & F.col("name").startswith(_PART)).select(F.concat_ws("/", "folder", "name").alias("folder"))
    both = top.unionByName(inner.repartition(_tasks(spark), "folder").mapInArrow(_entries, kind)).filter(~F.col("inner"))
    return written(both.groupBy("name").agg(F.max("folder").alias("folder")), "files")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, out, chars = [], [], 0
        for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist(), strict=True):
            store, path = _store(folder)
            with store.open_input_stream(f"{path}/{name}") as f:
                out.append(f.read().decode("utf-8-sig"))
            names.append(name)
            chars += len(out[-1])
            if chars >= _CHARS:
                yield pa.RecordBatch.from_pydict({"name": names, "text": out})
                names, out, chars = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"name": names, "text": out})


def texts(files: DataFrame) -> DataFrame:
    """``(name, text)`` of listed files, in UTF-8; each is read whole by one of many tasks."""
    dealt = files.select("folder", "name").repartition(_tasks(files.sparkSession))
    return dealt.mapInArrow(_texts, "name string, text string")
