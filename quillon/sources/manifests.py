"""Manifests and reports: small JSON and Markdown files, and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import split_names
from ..operators.tables import BASE, MODES, RUBRIC
from ..schemas import SPLIT


def read_ids(spark: SparkSession, path: str, keys: tuple[str, ...] = ("record_ids",)) -> DataFrame:
    """The distinct entries of a manifest's lists, as ``value``."""
    schema = ", ".join(f"`{k}` array<string>" for k in keys)
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.select(F.explode(F.concat(*(F.coalesce(k, F.array().cast("array<string>")) for k in keys))).alias("value")).distinct()


def subset_manifest(records: DataFrame, subset: str) -> DataFrame:
    """One row: the subset's records in order, and its series files, sorted.

    A manifest lists every record, so this row grows with the subset.
    """
    rows = F.array_sort(F.collect_list(F.struct("series_index", "window_index", "record_id")))
    return records.agg(
        F.lit(subset).alias("subset"), F.count("*").cast("int").alias("record_count"),
        F.transform(rows, lambda r: r["record_id"]).alias("record_ids"), F.sort_array(F.collect_set("series_file")).alias("series_files"),
    )


def split_manifest(names: DataFrame, name: str, seed: int = 72, share: float = 0.95) -> DataFrame:
    """One row: seed, share, and the names of both parts in their shuffled order.

    A manifest lists every name, so this row grows with them.
    """
    rows = split_names(names, name, seed, share)
    part = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("split") == s, F.struct("position", name)))), lambda r: r[name])
    columns = [F.lit(seed).alias("seed"), F.lit(share).alias("train_ratio"), part("train").alias("train_series"), part("val").alias("val_series")]
    return rows.agg(*columns).to(T.StructType.fromDDL(SPLIT))


def write_json(df: DataFrame, path: str) -> None:
    """A small report as one JSON file in a folder."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def markdown_table(table: DataFrame, intervals: DataFrame | None = None) -> str:
    """The score table as Markdown: a row a mode; for each question type its final and its dimensions.

    Below it stand the mean difference of each other mode to the base mode and its
    interval, if ``intervals`` (mode, mean, low, high) are given.  Numbers are
    formatted on the driver, with Python's rounding; the table has a few rows.
    Empty if a mode lacks a number.
    """
    kinds = sorted({k for k, _, _ in RUBRIC})
    metrics = [f"{k}/{part}" for k in kinds for part in ("final", *sorted(d for kind, d, _ in RUBRIC if kind == k))]
    cells = {(r["mode"], r["metric"]): r["value"] for r in table.collect()}
    found = {m for m, _ in cells}
    modes = [m for m in MODES if m in found] + sorted(found - set(MODES))
    if not all((m, c) in cells for m in modes for c in metrics):
        return ""
    rows = [["mode", *(c.replace("/", " ") for c in metrics)], ["---"] * (len(metrics) + 1)]
    rows += [[m, *(f"{cells[m, c]:.2f}" for c in metrics)] for m in modes]
    lines = [f"| {' | '.join(r)} |" for r in rows]
    if intervals is not None:
        known = {r["mode"]: r for r in intervals.collect()}
        lines += ["", f"Mean difference to {BASE}, 95% bootstrap interval:"]
        lines += [f"- {m}: {r['mean']:.3f} [{r['low']:.3f}, {r['high']:.3f}]" for m in modes if (r := known.get(m))]
    return "\n".join(lines) + "\n"
