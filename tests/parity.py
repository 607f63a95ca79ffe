"""Compare a Spark result with its SQL statement run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
import pandas as pd


def duck(source_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{source_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date()
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def rows(columns: list[str], data: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(cells, key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides hold the same columns and the same bag of rows."""
    mine = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} / {theirs[0]}"]
    if mine[1] == theirs[1]:
        return []
    out = [f"rows {len(mine[1])} / {len(theirs[1])}"]
    a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
    out += [f"only spark: {r[:400]}" for r in sorted(a - b)[:3]]
    out += [f"only sql:   {r[:400]}" for r in sorted(b - a)[:3]]
    return out
