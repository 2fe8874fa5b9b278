"""Compare a query with its SQL: row counts, column names and rows, whatever their order."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def connection(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    if isinstance(x, bytearray):
        return bytes(x)
    return x


def rows(columns: list[str], values: list[tuple]) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in values), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """"" if equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if a == b:
        return ""
    extra = [x for x in a if x not in set(b)][:2]
    missing = [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only in Spark {extra}; only in SQL {missing}"
