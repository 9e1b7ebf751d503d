"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(columns: list[str], data: list) -> list:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in data), key=lambda r: [(x is None, str(x)) for x in r])


def mismatch(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {df.columns} and {want.columns}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)} wanted"
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, float) and v is not None and abs(u - float(v)) < 2e-6):
                return f"{x} where {y} is wanted"
    return ""
