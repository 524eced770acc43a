"""Rasters over the TPC-H-like tables: integer expressions of dense keys, 100 columns wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["WIDTH", "RASTER_SQL", "raster"]

WIDTH = 100
_CELL = "cast({k} // 100 as int) as row, cast({k} % 100 as int) as col"
_ORDERS = _CELL.format(k="o_orderkey")
#: Each raster as SQL that DuckDB runs; Spark runs the same with ``div`` for ``//``.
RASTER_SQL = {
    "fmap": f"select {_ORDERS}, cast(case when o_custkey % 20 = 0 then 0 when o_custkey % 20 = 1 then 3 when o_custkey % 20 = 2 then 4 when o_custkey % 20 < 10 then 1 else 2 end as smallint) as v from orders",
    "fmap2": f"select {_ORDERS}, cast(case when o_custkey % 20 = 0 then 0 when o_custkey % 20 = 1 then 3 when o_custkey % 20 = 2 then 4 when (o_custkey + o_orderkey // 3) % 20 < 9 then 1 else 2 end as smallint) as v from orders",
    "bmap": f"select {_ORDERS}, cast(case when o_custkey % 20 = 0 then 0 when o_custkey % 20 < 5 then 1 else 2 end as smallint) as v from orders",
    # blocks of foreground with holes, so that cores, edges and perforations occur
    "kmap": f"select {_ORDERS}, cast(case when o_custkey % 150 = 0 then 0 when (o_orderkey // 100) % 16 < 12 and o_orderkey % 20 < 15 and o_custkey % 40 <> 7 then 2 when o_custkey % 23 = 0 then 2 else 1 end as smallint) as v from orders",
    "pmap": f"select {_ORDERS}, cast(case when o_custkey % 20 < 7 then 2 when o_custkey % 20 = 19 then 0 when o_custkey % 20 = 18 then 3 when o_custkey % 20 = 17 then 4 else 1 end as smallint) as v from orders",
    "lmap": f"select {_ORDERS}, cast(case when o_custkey % 10 = 0 then 0 else o_custkey % 3 + 1 end as smallint) as v from orders",
    "gmap": f"select {_CELL.format(k='event_id')}, cast(least(floor(value), 255) as smallint) as v from events",
}


def raster(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The cells of a virtual raster; only the columns that it needs are read."""
    table = "events" if name == "gmap" else "orders"
    # names of views are the session's: one for each folder
    view = f"{table}_{abs(hash(sf_dir)) % 10**12}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return spark.sql(RASTER_SQL[name].replace("//", "div").replace(f"from {table}", f"from {view}"))
