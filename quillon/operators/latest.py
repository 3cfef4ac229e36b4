"""Keys: the latest row of each, repeated ones, and agreement of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reconcile import key_difference


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` of each key, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return top.select(*keys, "_row.*").select(*df.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fail_on_duplicates(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df``, after a check that each key occurs once."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"duplicate {label} key {tuple(found[0])[:-1]!r}")
    return df


def first_of_difference(left: DataFrame, right: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The first keys, in order, that only one side has: at most ``most`` a side."""
    diff = key_difference(left, right, keys)
    sides = [diff.filter(F.col("side") == s).orderBy(*keys).limit(most) for s in ("left", "right")]
    return sides[0].unionByName(sides[1])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], label: str) -> None:
    """Raise if the key sets differ; names the first five keys of each side, in order."""
    found = first_of_difference(left, right, keys).collect()
    if found:
        sides = {s: [tuple(r)[:-1] for r in found if r["side"] == s] for s in ("left", "right")}
        raise ValueError(f"{label} key mismatch: " + "; ".join(f"only {s}: {k!r}" for s, k in sides.items() if k))
