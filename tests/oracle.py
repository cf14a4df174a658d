"""Runs a query's oracle SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.5f}" if abs(v) < 1e6 else f"{v:.4e}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def oracle_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted(str([plain(r[i]) for i in at]) for r in got.fetchall())
