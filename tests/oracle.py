"""Comparison of a Spark query with its DuckDB statement, by name, type class and value."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float, bool)) else (True, "", float(x)) for x in r))


def compare(df, sql: str, con) -> str:
    """Empty if equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} {len(want[1])}; first {got[1][:1]} {want[1][:1]}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ: {bad[:2]}" if bad else ""
