"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        x = round(x, 6)
        return int(x) if x == int(x) else x
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return cols, ours, theirs


def assert_same(spark, query, sql, sf_dir):
    cols, ours, theirs = both(spark, query, sql, sf_dir)
    if ours != theirs:
        differ = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:3]
        raise AssertionError(f"{cols}: {len(ours)} and {len(theirs)} rows; {str(differ)[:1500]}")
    assert ours, "no rows to compare"
