"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def rows_of_sql(con, sql, names):
    q = con.sql(sql)
    at = [q.columns.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=lambda r: [(x is None, str(x)) for x in r])
