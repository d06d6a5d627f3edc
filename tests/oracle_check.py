"""Compares registered queries with their SQL: rows, columns and values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(x) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
        return "~"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(x)
    return str(x)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_cell(x) for x in row)
                  for row in df[sorted(df.columns)].itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return None
    extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} / {len(b)}\n  only Spark: {extra}\n  only SQL: {missing}"
