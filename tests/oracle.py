"""Run a query and its DuckDB twin and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str):
    df = query(spark, sf_dir)
    cols, got = rows(df.columns, df.collect())
    res = con.sql(sql)
    want_cols, want = rows(res.columns, res.fetchall())
    if cols != want_cols:
        return f"columns {cols} and {want_cols}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows, first differences {bad}"
    return "" if got else "no rows"
