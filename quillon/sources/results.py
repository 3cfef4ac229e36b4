"""Result files with names of their own: series, YAML results, the manifest of a run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .named_files import part, register


def write_named(rows: DataFrame, folder: str, spread: bool = False) -> int:
    """Write each row (name, text) as a file of that name, all or none; returns how many rows there were.

    ``spread`` deals very many files into subfolders: rows go to tasks by
    subfolder, so the job moves subfolders at its end, not files.
    """
    register(rows.sparkSession)
    seen = Observation()
    rows = rows.select("name", "text").observe(seen, F.count(F.lit(1)).alias("n"))
    if spread:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), part("name"))
    rows.write.format("named_files").option("path", folder).option("spread", str(spread)).mode("append").save()
    return seen.get["n"]


def write_series(series: DataFrame, folder: str, spread: bool = False) -> int:
    """Write each row (series_file, sample_id, original_data, windows) as a JSON file of its own."""
    body = F.to_json(F.struct("sample_id", "original_data", "windows"))
    return write_named(series.select(F.col("series_file").alias("name"), body.alias("text")), folder, spread)


def yaml_text(columns: list[str]) -> Column:
    """A row as a YAML mapping, a line a column; values are written in their JSON form, which is YAML."""
    value = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', "$1")
    return F.concat(*(F.concat(F.lit(f"{c}: "), value(c), F.lit("\n")) for c in columns))


def write_yaml_results(results: DataFrame, folder: str, index: str, suffix: str = "") -> int:
    """Write each row as ``question_<index in six digits><suffix>.yaml``."""
    rest = [c for c in results.columns if c != index]
    name = F.concat(F.lit("question_"), F.lpad(F.col(index).cast("string"), 6, "0"), F.lit(f"{suffix}.yaml"))
    return write_named(results.select(name.alias("name"), yaml_text(rest).alias("text")), folder)


def run_manifest(spark: SparkSession, predictions: DataFrame, settings: dict[str, object], checkpoint_digest: Column | None = None) -> DataFrame:
    """One row: the settings of a run as JSON, the digest of its checkpoint, and its number of rows."""
    counted = predictions.agg(F.count("*").alias("rows"))
    return counted.select(
        F.lit(json.dumps(settings, sort_keys=True)).alias("settings"),
        (checkpoint_digest if checkpoint_digest is not None else F.lit(None).cast("string")).alias("checkpoint_sha256"), "rows",
    )
