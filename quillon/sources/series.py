"""Series files: one JSON object a file, exploded to a record a window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numbered, short_subset, split_names
from ..schemas import SERIES_FILE
from . import named_files


def list_names(spark: SparkSession, folder: str) -> DataFrame:
    """``(series_file, folder)``: names of the series files and where they lie; listed by tasks, or by Spark in a store that only Spark reads."""
    if named_files.reachable(folder):
        files = named_files.listed(spark, folder).withColumnRenamed("name", "series_file")
    else:
        files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("series_file"), F.lit(folder).alias("folder"))
    names = files.filter(r"series_file rlike '^series_.*[.]json$'")
    if not names.limit(1).count():
        raise FileNotFoundError(f"no series_*.json in {folder}")
    return names


def read_series(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Series files as rows with ``series_file``, only the named ones if names (as listed) are given."""
    if not named_files.reachable(folder):
        df = spark.read.schema(SERIES_FILE).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "series_*.json").json(folder)
        df = df.withColumn("series_file", F.col("_metadata.file_name"))
        return df if names is None else df.join(names, "series_file", "left_semi")
    names = list_names(spark, folder) if names is None else names
    texts = named_files.texts(names.withColumnRenamed("series_file", "name"))
    rows = F.inline(F.from_json("text", f"array<struct<{SERIES_FILE}>>", {"mode": "FAILFAST"}))
    return texts.select(rows, F.col("name").alias("series_file"))


def records(series: DataFrame, order: DataFrame) -> DataFrame:
    """A record for each window of each series; ``order`` (series_file, position) numbers the series and picks them."""
    df = series.join(order, "series_file")
    df = df.select("series_file", F.col("position").cast("int").alias("series_index"), "sample_id", F.col("original_data.time_series").alias("time_series"), F.posexplode("windows").alias("window_index", "w"))
    return df.select(
        F.concat_ws(":", F.regexp_replace("series_file", r"\.json$", ""), F.col("window_index").cast("string")).alias("record_id"),
        "series_file", "series_index", "window_index", "sample_id", "time_series",
        F.coalesce("w.question", F.lit("")).alias("question"), F.coalesce("w.answer", F.lit("")).alias("answer"),
        F.coalesce("w.question_type", F.lit("unknown")).alias("question_type"),
        F.coalesce("w.window_range.start", F.lit(0)).alias("start_index"), F.coalesce(F.col("w.window_range")["end"], F.lit(0)).alias("end_index"),
        F.col("w.has_anomaly").alias("has_anomaly"),
    )


def load_records(spark: SparkSession, folder: str, subset: str = "full", seed: int = 42, max_records: int | None = None) -> DataFrame:
    """Records of all series in sorted order, or of the short shuffled slice ``paper140``."""
    names = list_names(spark, folder)
    if subset == "paper140":
        order = short_subset(names, "series_file", seed)
    elif subset == "full":
        order = numbered(names.select("series_file"), ["series_file"], "position")
    else:
        raise ValueError(f"unknown subset: {subset}")
    df = records(read_series(spark, folder, names.join(order, "series_file", "left_semi")), order)
    return df.orderBy("series_index", "window_index").limit(max_records) if max_records is not None else df


def load_split(spark: SparkSession, folder: str, split: str, seed: int = 42, share: float = 0.95) -> DataFrame:
    """Series of the training part, or (for any other name) of the rest."""
    names = list_names(spark, folder)
    part = split_names(names, "series_file", seed, share).filter(F.col("split") == ("train" if split == "train" else "val"))
    return read_series(spark, folder, names.join(part, "series_file", "left_semi"))


class SeriesCache:
    """Series folders that are kept read, ``capacity`` at most; the one unused the longest goes first."""

    def __init__(self, spark: SparkSession, capacity: int = 4):
        self._spark, self._capacity = spark, capacity
        self._held: dict[str, DataFrame] = {}

    def get(self, folder: str) -> DataFrame:
        df = self._held.pop(folder, None)
        if df is None:
            df = read_series(self._spark, folder).persist(StorageLevel.MEMORY_AND_DISK)
        self._held[folder] = df
        while len(self._held) > self._capacity:
            self._held.pop(next(iter(self._held))).unpersist()
        return df

    def folders(self) -> list[str]:
        return list(self._held)


__all__ = ["SeriesCache", "list_names", "load_records", "load_split", "read_series", "records"]
