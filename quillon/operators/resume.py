"""Work still to do: tasks less what is done, less what is pending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import score_from_text
from ..scratch import written
from .latest import latest
from .tables import rubric

TASK = ["record_id", "mode", "dimension"]


def unknown_types(predictions: DataFrame) -> DataFrame:
    """Predictions whose question type has no dimensions, which :func:`judge_tasks` refuses."""
    return predictions.join(F.broadcast(rubric(predictions.sparkSession).select("question_type").distinct()), "question_type", "left_anti")


def judge_tasks(predictions: DataFrame) -> DataFrame:
    """A row for each prediction and dimension of its type; unknown types are an error."""
    dims = F.broadcast(rubric(predictions.sparkSession))
    tasks = predictions.join(dims, "question_type", "left")
    known = F.when(F.col("dimension").isNull(), F.raise_error(F.concat(F.lit("unknown question type "), F.coalesce("question_type", F.lit("null"))))).otherwise(F.col("dimension"))
    return tasks.withColumn("dimension", known)


#: Bits of the filter a done key, places a key, and bits at most (16 MB).
BITS, PLACES, MOST_BITS = 12, 4, 1 << 27


def _places(keys: list[str], bits: int) -> list[Column]:
    """Places of a key's bits, from two halves of its hash."""
    h = F.xxhash64(*keys)
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
    return [(low + high * k) % bits for k in range(PLACES)]


def done_filter(done: DataFrame, keys: list[str]) -> tuple[DataFrame, int] | None:
    """A Bloom filter of the done keys: one row ``words`` (array<long>) and its bits; None if it would be too large.

    It is sized from the number of rows; about 3 in 1000 keys that aren't done
    pass it too.
    """
    n = done.count()
    bits = 64 * max(1, -(-n * BITS // 64))
    if bits > MOST_BITS:
        return None
    at = done.select(F.explode(F.array(*_places(keys, bits))).alias("_at"))
    set_ = at.groupBy(F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))).alias("_bits"))
    every = done.sparkSession.range(bits // 64).select(F.col("id").alias("_word"))
    words = every.join(set_, "_word", "left").select("_word", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits"))
    row = written(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_word", "_bits"))), lambda x: x["_bits"]).alias("words")), "filter")
    return row, bits


def maybe_done(keys: list[str], words: Column, bits: int) -> Column:
    """False if a key surely isn't among those of the filter."""
    hit = [F.call_function("shiftrightunsigned", F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _places(keys, bits)]
    out = hit[0]
    for h in hit[1:]:
        out = out & h
    return out


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tasks whose key isn't done.

    A filter of the done keys stands in the plan as one value: tasks that are
    surely not done are passed on where they are, and only the others are joined
    with the done keys.  So the first start of a long run shuffles next to
    nothing.  Very many done keys, whose filter would be too large, are joined
    without it.  A key with a null is never done, and no key is changed.
    """
    keys = keys or TASK
    done = written(done.select(*keys).dropna(), "done")
    join = lambda df: df.join(done.distinct(), keys, "left_anti").select(*tasks.columns)
    found = done_filter(done, keys)
    if found is None:
        return join(tasks)
    row, bits = found
    known = F.coalesce(maybe_done(keys, row.scalar(), bits), F.lit(False))
    return tasks.filter(~known).unionByName(join(tasks.filter(known)))


def usable_pending(journal: DataFrame, order: str = "_line_no") -> DataFrame:
    """The latest journal row of each task, if its judgement states a score."""
    return latest(journal, TASK, order).filter(score_from_text(F.col("content")).isNotNull())


def partial_groups(rows: DataFrame, group: str, done: str) -> DataFrame:
    """Groups that are done in part, which a batch runner must not resume."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(done)).alias("n_done"))
    return n.filter("n_done > 0 and n_done < n")


def unwrapped(journal: DataFrame) -> DataFrame:
    """Journal rows with the columns record_id and mode of their inner row, where there is one."""
    if "row" not in journal.columns:
        return journal
    inner = [f.name for f in journal.schema["row"].dataType.fields]
    own = lambda c: F.col(c) if c in journal.columns else F.lit(None).cast("string")
    return journal.withColumns({c: F.coalesce(f"row.{c}", own(c)) if c in inner else own(c) for c in ("record_id", "mode")})


def only_records(rows: DataFrame, manifest: DataFrame, modes: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose record is in the manifest (and mode among ``modes``); journal rows by their inner row."""
    rows = unwrapped(rows)
    rows = rows.filter(F.col("mode").isin(*modes)) if modes else rows
    return rows.join(manifest.select("record_id").distinct(), "record_id", "left_semi")
