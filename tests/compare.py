"""Spark results held against SQL, as sets of rows with normalised values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return db


def plain(x: object) -> object:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    return x


def differences(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same rows and columns."""
    cols = sorted(spark_df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=str)
    rel = db.sql(sql)
    names = sorted(rel.columns)
    if names != cols:
        return f"columns {cols} and {names}"
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]} of {cols}" if bad else None
