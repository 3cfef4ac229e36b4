"""Tables that are written once and read again, in a folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder under ``spark.checkpoint.dir``; a local one only where that is unset on one machine."""
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="quillon-")
        _ROOTS[sc.applicationId] = f"{base.rstrip('/')}/quillon-tables-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, sc, _ROOTS[sc.applicationId])
    return f"{_ROOTS[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(sc, root: str) -> None:
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whatever follows."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
