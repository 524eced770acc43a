"""The registered raster queries: every operator over whole tables of virtual rasters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import statistics as st
from quadrille.functions.mosaic import mosaic_group
from quadrille.operators import change as ch
from quadrille.operators import morphology as mo
from quadrille.operators import patches as pt
from quadrille.operators import window as wi
from quadrille.operators import zonal as zo
from quadrille.plans import oracle, report
from quadrille.sources.virtual import raster

__all__ = ["queries", "oracle_sql", "zones"]

Query = Callable[[SparkSession, str], DataFrame]
WINDOW = 27


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums come in any order."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _frag(method: str, conn: int = 4, window: int = WINDOW, fixed: bool = False, form: str = "cell", name: str = "fmap") -> Query:
    return lambda s, d: wi.fragmentation(raster(s, d, name), method, window, conn, fixed, form)


def _gray(method: str, conn: int = 4, window: int = 9, threshold: int = 30, fixed: bool = False, form: str = "cell") -> Query:
    return lambda s, d: wi.fragmentation_gray(raster(s, d, "gmap"), method, window, threshold, conn, fixed, form)


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return wi.fragmentation(raster(s, d, "fmap"), "FAD", 7, form="tile"), wi.fragmentation(raster(s, d, "fmap2"), "FAD", 7, form="tile")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rings a region: a lozenge and a hole in it, with whole-numbered corners."""
    k = F.col("r_regionkey").cast("double")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    cx, cy = 15 + 17 * k, -(20 + 5 * k)
    ring = lambda a, b: F.array(p(cx - a, cy), p(cx, cy + b), p(cx + a, cy), p(cx, cy - b))
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("zone"), F.array(ring(14, 19), ring(4, 6)).alias("rings"))


def _mosaic19(s: SparkSession, d: str) -> DataFrame:
    return wi.mosaic(raster(s, d, "lmap"), 7).select("row", "col", mosaic_group(F.col("v")).cast("short").alias("v"))


QUERIES: dict[str, Query] = {
    "frag_fad": _frag("FAD"),
    "frag_fac4": _frag("FAC", 4),
    "frag_fac8": _frag("FAC", 8),
    "frag_fed4": _frag("FED", 4),
    "frag_fed8": _frag("FED", 8),
    "frag_fad_fixed": _frag("FAD", window=7, fixed=True),
    "frag_fac8_fixed": _frag("FAC", 8, 7, True),
    "frag_fed4_fixed": _frag("FED", 4, 7, True),
    "frag_fad_tiles": _frag("FAD", form="tile"),
    "frag_fac8_tiles": _frag("FAC", 8, form="tile"),
    "frag_fed8_tiles": _frag("FED", 8, form="tile"),
    "frag_histogram": lambda s, d: rounded(st.full_histogram(_frag("FAD", form="tiles")(s, d))),
    "frag_stats": lambda s, d: rounded(st.fragmentation_stats(_frag("FAC", 8, form="tiles")(s, d))),
    "gray_fad": _gray("FAD"),
    "gray_fac4": _gray("FAC", 4),
    "gray_fac8": _gray("FAC", 8),
    "gray_fed4": _gray("FED", 4),
    "gray_fed8": _gray("FED", 8),
    "gray_fad_fixed": _gray("FAD", fixed=True),
    "gray_fac8_fixed": _gray("FAC", 8, fixed=True),
    "gray_fed8_tiles": _gray("FED", 8, form="tile"),
    "gray_stats": lambda s, d: rounded(st.gray_stats(raster(s, d, "gmap"), _gray("FAD", form="tiles")(s, d))),
    "mosaic_103": lambda s, d: wi.mosaic(raster(s, d, "lmap"), 7),
    "mosaic_103_tiles": lambda s, d: wi.mosaic(raster(s, d, "lmap"), 7, "tile"),
    "mosaic_19": _mosaic19,
    "mosaic_groups": lambda s, d: rounded(st.mosaic_groups(wi.mosaic(raster(s, d, "lmap"), 7, "tiles"))),
    "mosaic_stats": lambda s, d: rounded(st.mosaic_stats(wi.mosaic(raster(s, d, "lmap"), 7, "tiles"))),
    "mosaic_table": lambda s, d: report.mosaic_table(wi.mosaic(raster(s, d, "lmap"), 7, "tiles")),
    "change_map": lambda s, d: ch.change(*_pair(s, d)),
    "change_crosstab": lambda s, d: ch.crosstab(*_pair(s, d)),
    "change_matrix": lambda s, d: ch.aggregate_matrix(ch.crosstab(*_pair(s, d)), ch.CLASS_GROUPS),
    "change_land": lambda s, d: ch.aggregate_matrix(ch.crosstab(*_pair(s, d)), ch.LAND_GROUPS),
    "change_stats": lambda s, d: rounded(st.change_stats(ch.crosstab(*_pair(s, d)))),
    "change_differences": lambda s, d: rounded(st.change_differences(ch.crosstab(*_pair(s, d)))),
    "change_histogram": lambda s, d: rounded(st.change_histogram(ch.change(*_pair(s, d)))),
    "acc_map": lambda s, d: pt.accounting(raster(s, d, "pmap"), [2, 10, 50]),
    "acc_stats": lambda s, d: rounded(pt.accounting_stats(raster(s, d, "pmap"), [2, 10, 50])),
    "rss": lambda s, d: rounded(pt.restoration(raster(s, d, "pmap"))),
    "spa_6": lambda s, d: mo.spa(raster(s, d, "kmap"), 1, 6),
    "spa_5": lambda s, d: mo.spa(raster(s, d, "kmap"), 2, 5),
    "spa_3": lambda s, d: mo.spa(raster(s, d, "kmap"), 1, 3),
    "spa_2": lambda s, d: mo.spa(raster(s, d, "kmap"), 1, 2),
    "spa_stats": lambda s, d: rounded(st.spa_stats(mo.spa(raster(s, d, "kmap"), 1, 6))),
    "mspa": lambda s, d: mo.mspa(raster(s, d, "kmap"), 8, 1),
    "mspa_stats": lambda s, d: rounded(st.mspa_stats(mo.mspa(raster(s, d, "kmap"), 8, 1))),
    "zonal_histogram": lambda s, d: zo.zonal_histogram(raster(s, d, "fmap"), zones(s, d), zo.Grid()),
    "zonal_extract": lambda s, d: zo.extract(raster(s, d, "fmap"), zones(s, d), zo.Grid(), 102),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
