"""Runs a query and its SQL side by side on the same Parquet tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} rows differ, as {odd[:2]}" if odd else ""
