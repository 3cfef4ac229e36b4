"""JSON lines: strict scans under a schema, overwriting and appending sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, line_numbers: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed line is an error.

    ``line_numbers`` adds ``_line_no``, which orders the rows of a file as they
    stand (increasing, not consecutive): file name, then place in the file.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)
    return df.withColumn("_line_no", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())) if line_numbers else df


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def merge_shards(shards: list[DataFrame], path: str) -> DataFrame:
    """Shards put together, sorted by record and mode, written once."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    write_jsonl(out.orderBy("record_id", "mode"), path)
    return out
