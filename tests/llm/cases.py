"""Awkward documents that every operator has to take, and helpers."""

from __future__ import annotations

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "fp long, k long, th long, raw binary, kept string, n_removed string, score string, lang_pred string, shard int, root long, ranges int, g long, n long, seat long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boxed by the river all day long and nobody saw them leave"


def rows() -> list[tuple]:
    long = " ".join(f"word{i % 997} of{i % 13}" for i in range(60_000))
    texts = [None, "", " \t\n", "a", "a b", PROSE, PROSE, PROSE.replace("lazy", "idle"), "ÀÉ ß 漢字 \U0001f600 " * 40, long, long, "x" * 5000, "\\ <| |> \0 tail", "1 2 3 4 5 6"]
    out = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[5], (None, PROSE, None, None, None), (None, None, None, None, None)]


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    from pyspark.sql import functions as F

    extra = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in EXTRA.split(", ")]
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).select("*", *extra)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(sql: str, sf_dir: str, *tables: str) -> set[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return {tuple(r[i] for i in order) for r in got.fetchall()}


def found(df) -> set[tuple]:
    return {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}
