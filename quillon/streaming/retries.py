"""Retries of judged tasks as state: attempts come in, one verdict a task goes out.

Attempts are rows of a stream, recorded by whatever made the calls.  The state of
a task is how often it was tried and until when the next attempt may come; it
survives restarts with the stream's checkpoint.  State travels with a task's rows
in Arrow batches: nothing is asked for key by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.judging import RETRIABLE

VERDICTS = "task string, verdict string, attempts int, at timestamp"
#: A task without ``due`` has its verdict.  Times are microseconds inside.
_STATE, _OUT = "tasks array<string>, attempts array<int>, due array<bigint>", "task string, verdict string, attempts int, at long"
#: Buckets that tasks are dealt to by hash; what a stream starts with has to stay.
BUCKETS, _FIRST = 4096, -(1 << 62)
_STORE = "spark.sql.streaming.stateStore.providerClass"


def outcome(code: int | None, attempts: int, most: int) -> str | None:
    """Verdict after an attempt: done (200), permanent, exhausted after ``most``; None if it may be tried again."""
    if code == 200:
        return "done"
    if not (code is None or code in RETRIABLE or 500 <= code <= 599):
        return "permanent"
    return "exhausted" if attempts >= most else None


def _follow(most: int, patience: int):
    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A bucket's attempts of a batch, or its next end of time: verdicts, and the new state of its tasks."""
        tasks = {t: (n, due) for t, n, due in zip(*state.get, strict=True)} if state.exists else {}
        held = [] if state.hasTimedOut else [r for p in parts for r in zip(p["at"].tolist(), p["task"].tolist(), p["code"].tolist(), strict=True)]
        told = []
        for at, task, code in sorted(held, key=lambda r: r[0]):
            attempts, due = tasks.get(task, (0, _FIRST))
            if due is None:
                continue  # a verdict stands; what comes after it changes nothing
            if due != _FIRST and at > due:
                verdict, at = "expired", due
            else:
                attempts, due = attempts + 1, at + patience
                verdict = outcome(None if code != code else int(code), attempts, most)
            tasks[task] = (attempts, None if verdict else due)
            if verdict:
                told.append((task, verdict, attempts, at))
        now = state.getCurrentWatermarkMs()
        for task, (attempts, due) in tasks.items():
            if due is not None and due // 1000 <= now:
                told.append((task, "expired", attempts, due))
                tasks[task] = (attempts, None)
        state.update(([*tasks], [n for n, _ in tasks.values()], [due for _, due in tasks.values()]))
        waiting = [due for _, due in tasks.values() if due is not None]
        if waiting:
            state.setTimeoutTimestamp(min(waiting) // 1000 - 1)  # it fires when the stream's time is past this, that is, has come to the first one due
        yield pd.DataFrame(told, columns=["task", "verdict", "attempts", "at"])

    return follow


def verdicts(attempts: DataFrame, most: int, patience: str = "2 days", buckets: int = BUCKETS) -> DataFrame:
    """``(task, verdict, attempts, at)`` of a stream of attempts (task, ts, code); each task has one row at most.

    An attempt with code 200 ends a task as done, one that can't succeed later as
    permanent, and ``most`` others as exhausted.  A task whose next attempt hasn't
    come ``patience`` after the last one is expired: at the time of the stream,
    whose rows come in the order of ``ts`` but for those of one batch.  A null
    code is a lost connection.  Rows after a task's verdict are ignored.

    State is kept by bucket of tasks, not by task: a call of Python costs about a
    millisecond, whatever it holds.  A bucket's state is one row; give more
    ``buckets`` where they would hold more than some thousands of tasks.
    """
    rows = attempts.select(F.col("task").cast("string").alias("task"), "ts", F.unix_micros("ts").alias("at"), F.col("code").cast("int").alias("code"), F.pmod(F.xxhash64(F.col("task").cast("string")), F.lit(buckets)).alias("bucket"))
    follow = _follow(most, pd.Timedelta(patience).value // 1000)
    out = rows.withWatermark("ts", "0 seconds").groupBy("bucket").applyInPandasWithState(follow, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("at"))


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop; started again, it goes on from the checkpoint.

    State lies in the RocksDB store, outside of the executors' heap; it is set for this query only.
    """
    conf = rows.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_STORE, before)
