"""What the operators of this subpackage share: scratch tables and settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, as a character class body.
SPACE = r"\x20\x09-\x0D"
_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors share.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``;
    only where that is unset (tests on one machine) a local folder serves.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        root = f"{base.rstrip('/')}/quillon-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        _ROOTS[sc.applicationId] = root
        atexit.register(_remove, sc, root)
    return _ROOTS[sc.applicationId]


def _remove(sc, root: str) -> None:
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """URI of a new, not yet existing scratch folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends here.

    Lost executors then cost a re-read, not a recomputation of all before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the texts that a Python worker holds at once: rows of an Arrow batch.

    Plans are lazy, so the bound has to stand until they run: it is only ever
    lowered, and a smaller one of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    trimmed = F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, rf"[{SPACE}]+")))
    return F.coalesce(n, F.lit(0)).cast("long")
