"""Change between two fragmentation results on one grid."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["change", "change_code", "crosstab", "aggregate_matrix", "LAND_GROUPS", "CLASS_GROUPS"]

LAND_GROUPS = {"foreground": range(0, 101), "background": (101,), "special": (105, 106)}
CLASS_GROUPS = {"background": (101,), "rare": range(0, 10), "patchy": range(10, 40), "transitional": range(40, 60), "dominant": range(60, 90), "interior": range(90, 101)}


def change_code(a: Column, b: Column) -> Column:
    """252 background twice, 250 gain, 251 loss, 0-200 change of the metric (100 + a - b, so
    below 100 connectivity rose), 254 missing, 253 special, 102 anything else; first match wins."""
    return (
        F.when((a == 101) & (b == 101), 252)
        .when((a == 101) & (b <= 100), 250)
        .when((a <= 101) & (b == 101), 251)
        .when((a <= 100) & (b <= 100), 100 + a - b)
        .when((a == 102) | (b == 102), 254)
        .when(a.isin(105, 106) | b.isin(105, 106), 253)
        .otherwise(102)
    )


def _pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("row", "col", F.col("v").cast("long").alias("a")).join(after.select("row", "col", F.col("v").cast("long").alias("b")), ["row", "col"])


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``row, col, v`` with the change code of each cell."""
    return _pairs(before, after).select("row", "col", change_code(F.col("a"), F.col("b")).cast("short").alias("v"))


def crosstab(before: DataFrame, after: DataFrame) -> DataFrame:
    """``a, b, n``: cells by value before and after; values over 106 are left out."""
    return _pairs(before, after).where("a <= 106 and b <= 106").groupBy("a", "b").agg(F.count("*").alias("n"))


def aggregate_matrix(tab: DataFrame, groups: Mapping[str, object]) -> DataFrame:
    """A cross-tabulation by groups of values, with margins: ``ga, gb, n``; ``total`` in a margin.

    Values of no group are left out, and so are pairs that don't occur.
    """
    def name(c: str) -> Column:
        out = F.lit(None).cast("string")
        for k, values in groups.items():
            out = F.when(F.col(c).isin(*map(int, values)), k).otherwise(out)
        return out

    x = tab.select(name("a").alias("ga"), name("b").alias("gb"), "n").where("ga is not null and gb is not null")
    return x.cube("ga", "gb").agg(F.sum("n").cast("long").alias("n")).select(F.coalesce("ga", F.lit("total")).alias("ga"), F.coalesce("gb", F.lit("total")).alias("gb"), "n").where("n is not null")
