"""DuckDB beside Spark: equal column names and equal multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def assert_same(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    expected = Counter(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    actual = Counter(tuple(_plain(r[c]) for c in names) for r in df.collect())
    assert actual == expected
    return sum(expected.values())
