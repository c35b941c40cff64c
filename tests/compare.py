"""Run a query in Spark and its SQL in DuckDB on the same tables, and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return value


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def difference(df, con, sql: str) -> str:
    """Empty if names and rows agree."""
    got = con.execute(sql)
    names, want = [d[0] for d in got.description], got.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, want)
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
