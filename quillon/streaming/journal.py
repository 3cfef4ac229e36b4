"""Structured Streaming of tasks: done once, split in two sinks, resumed by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(fmt).load(path)


def once_by_key(rows: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key.

    Without an event time the keys that were seen are kept for ever, as a done
    set is; with one, state is dropped ``delay`` after a key's event time.
    """
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def two_sinks(rows: DataFrame, finished: Column, done_path: str, pending_path: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Write finished rows to one folder and the others to a pending journal.

    A batch is written under its number, overwriting: a batch that is run again
    after a failure leaves its rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = judge(batch).withColumn("_finished", F.coalesce(finished, F.lit(False))).persist()
        try:
            for flag, path in ((True, done_path), (False, pending_path)):
                out.filter(F.col("_finished") == flag).drop("_finished").write.mode("overwrite").json(f"{path}/batch={number}")
        finally:
            out.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """What a query has done so far: batch, rows of the batch, all rows, and its state."""
    out, total = [], 0
    for p in query.recentProgress:
        total += p["numInputRows"]
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "processed": total, "state": "active" if query.isActive else "done"})
    return out
