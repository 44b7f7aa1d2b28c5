"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    """A connection with a view for each of the folder's tables."""
    db = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return db


def plain(v: object) -> object:
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, decimal.Decimal | float):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


def rows(columns: list[str], values: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


def differences(spark, query, sql: str, sf: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    r = db.execute(sql)
    columns = [d[0] for d in r.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    want = rows(columns, r.fetchall())
    if got == want:
        return ""
    mine, theirs = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; only Spark: {sorted(mine)[:3]}; only SQL: {sorted(theirs)[:3]}"
