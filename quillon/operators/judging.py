"""Judging through a pluggable client: tasks, bounded retries, sampling, two phases.

A client is any picklable callable ``(prompt: str, attempt: int) -> dict`` that
returns a recorded or live response.  It runs inside ``mapInPandas``, a bounded
thread pool a partition; verdicts are columns, so one failing task never fails
the job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .text_score import written_score

#: HTTP codes that may pass, and the bounds of waiting and sampling.
RETRIABLE = frozenset({408, 409, 425, 429})
MAX_WAIT, MAX_DOUBLINGS = 60.0, 5


class JudgeError(Exception):
    """A failed call; ``code`` is the HTTP status, None for a connection error."""

    def __init__(self, code: int | None = None, message: str = ""):
        super().__init__(message or str(code))
        self.code = code


def is_retriable(error: Exception) -> bool:
    """Whether a call may succeed later: some codes, server errors, lost connections."""
    if isinstance(error, JudgeError):
        return error.code is None or error.code in RETRIABLE or 500 <= error.code <= 599
    return isinstance(error, TimeoutError | ConnectionError)


def wait_seconds(round_: int) -> float:
    return min(MAX_WAIT, 2.0 ** min(round_, MAX_DOUBLINGS))


def wait_column(round_: Column) -> Column:
    """:func:`wait_seconds` of a column."""
    return F.least(F.lit(MAX_WAIT), F.pow(F.lit(2.0), F.least(round_, F.lit(MAX_DOUBLINGS))))


def call(client: Callable[[str, int], dict], prompt: str, max_rounds: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str, dict | None, int]:
    """(verdict, response, attempts): done, permanent or exhausted."""
    for attempt in range(1, max_rounds + 1):
        try:
            return "done", client(prompt, attempt), attempt
        except Exception as error:  # noqa: BLE001  a client may raise anything; the verdict tells
            if not is_retriable(error):
                return "permanent", None, attempt
            if attempt < max_rounds:
                sleep(wait_seconds(attempt))
    return "exhausted", None, max_rounds


def judge(tasks: DataFrame, client: Callable[[str, int], dict], max_rounds: int = 12, workers: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``tasks`` (record_id, mode, dimension, prompt) with verdict, attempts and the response as JSON."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in parts:
                found = list(pool.map(lambda p: call(client, p, max_rounds, sleep), pdf["prompt"]))
                yield pdf.assign(
                    verdict=[v for v, _, _ in found], attempts=[n for _, _, n in found],
                    response=[None if r is None else json.dumps(r, ensure_ascii=False) for _, r, _ in found],
                )

    rows = tasks.select("record_id", "mode", "dimension", "prompt")
    return rows.mapInPandas(run, "record_id string, mode string, dimension string, prompt string, verdict string, attempts long, response string")


def sample_scores(tasks: DataFrame, client: Callable[[str, int], dict], count: int = 20) -> DataFrame:
    """``(record_id, mode, dimension, fallback_scores, score)``: the mean of exactly ``count`` scores.

    At most max(100, 5 * count) calls a task; too few valid scores leave null.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for prompt in pdf["prompt"]:
                scores: list[int] = []
                for attempt in range(1, max(100, 5 * count) + 1):
                    if len(scores) == count:
                        break
                    _, response, _ = call(lambda p, _, n=attempt: client(p, n), prompt, 1)
                    choice = ((response or {}).get("choices") or [{}])[0]
                    value = written_score(choice.get("message", {}).get("content") or "")
                    if value is not None:
                        scores.append(value)
                out.append(scores if len(scores) == count else None)
            yield pdf[["record_id", "mode", "dimension"]].assign(fallback_scores=out)

    rows = tasks.select("record_id", "mode", "dimension", "prompt")
    drawn = rows.mapInPandas(run, "record_id string, mode string, dimension string, fallback_scores array<int>")
    total = F.aggregate("fallback_scores", F.lit(0), lambda s, x: s + x)
    return drawn.withColumn("score", total / F.size("fallback_scores"))


def default_prompt() -> Column:
    """A judge's prompt from the columns of a task."""
    return F.format_string(
        "Judge one aspect of an answer: %s.\n\nQuestion: %s\nExpected answer: %s\nGiven answer: %s\n\nReason briefly, then end with a line **Score:** n, n from 1 to 5.",
        F.replace("dimension", F.lit("_"), F.lit(" ")), "question", "answer", "response",
    )


def two_phases(judged: DataFrame, distribution: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a distribution, and the pending rest whose judgement states a score."""
    rows = judged.withColumn("_d", distribution)
    return rows.filter("_d is not null").withColumnRenamed("_d", "distribution"), rows.filter(F.col("_d").isNull() & T.score_from_text(F.col("content")).isNotNull()).drop("_d")
