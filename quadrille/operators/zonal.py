"""Polygons over rasters: which cells lie inside, extraction and zonal statistics.

Polygons are rows ``zone, rings`` with ``rings ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>``. They
are turned into column spans per raster row, cut to the raster where its size is known. Spans
meet the raster by an equi-join on the row and a stretch of columns, with a test of the range,
and not by a test of every cell against every polygon.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["Grid", "polygon_spans", "polygon_cells", "extract", "zonal_histogram", "zone_name", "nodata_of"]

#: What fills the outside of a clip, by tool.
NODATA = {"mspa": 129, "spa": 129, "frag": 102, "acc": 129, "mosaic": 0, "change": 254}


#: Columns of a stretch, by which spans and cells meet.
STRETCH = 256


@dataclass(frozen=True)
class Grid:
    """Upper left corner and cell size; rows run down. ``rows`` and ``cols``, where known, are the raster's."""

    x0: float = 0.0
    y0: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    rows: int | None = None
    cols: int | None = None


def nodata_of(tool: str | None, header: int | None = None) -> int:
    """The fill value of a tool's result, else the header's, else 0."""
    return NODATA.get(tool, header or 0)


def zone_name(value: Column, index: Column) -> Column:
    """A name for a zone: its id with spaces and slashes replaced, or ``feature_<index>``."""
    return F.coalesce(F.translate(value.cast("string"), " /", "_-"), F.concat(F.lit("feature_"), index.cast("string")))


def polygon_spans(polygons: DataFrame, grid: Grid) -> DataFrame:
    """``zone, row, first, last``: runs of cells whose centres are inside, by the even-odd rule.

    A centre on a left or lower edge is inside, on a right or upper one outside, so that polygons
    side by side share no cell. Self-crossing rings need no repair; rings are closed if they
    aren't; empty and null geometries give nothing.
    """
    g = grid
    rings = polygons.select("zone", F.explode("rings").alias("p"))
    rings = rings.where(F.size("p") >= 3).select("zone", "p", F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1)).alias("q"))
    edges = rings.select("zone", F.explode(F.arrays_zip("p", "q")).alias("e")).select("zone", *[F.col(f"e.{a}.{c}").alias(f"{c}{k}") for k, a in ((1, "p"), (2, "q")) for c in ("x", "y")])
    # rows whose centre's y is in [low, high)
    row = lambda y: (F.lit(g.y0) - y) / g.res_y - 0.5
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    top, bottom = F.floor(row(high)) + 1, F.floor(row(low))
    e = edges.withColumns({"a": top.cast("long"), "b": bottom.cast("long")})
    if g.rows is not None:
        e = e.withColumns({"a": F.greatest("a", F.lit(0)), "b": F.least("b", F.lit(g.rows - 1))})
    e = e.where("a <= b").withColumn("row", F.explode(F.sequence("a", "b")))
    y = F.lit(g.y0) - (F.col("row") + 0.5) * g.res_y
    cross = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    hits = e.select("zone", "row", cross.alias("x")).groupBy("zone", "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    col = lambda x: F.ceil((x - g.x0) / g.res_x - 0.5)  # noqa: E731  the first centre at or beyond x
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(col(F.get("xs", i)).alias("first"), (col(F.get("xs", i + 1)) - 1).alias("last")))
    spans = hits.where(F.size("xs") >= 2).select("zone", F.col("row").cast("int").alias("row"), F.explode(pairs).alias("s")).select("zone", "row", F.col("s.first").alias("first"), F.col("s.last").alias("last"))
    if g.cols is not None:
        spans = spans.select("zone", "row", F.greatest("first", F.lit(0)).alias("first"), F.least("last", F.lit(g.cols - 1)).alias("last"))
    return spans.select("zone", "row", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")).where("first <= last")


def polygon_cells(polygons: DataFrame, grid: Grid) -> DataFrame:
    """``zone, row, col`` of all cells inside, of the raster or not."""
    return polygon_spans(polygons, grid).select("zone", "row", F.explode(F.sequence("first", "last")).alias("col"))


def _met(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """``cells`` with every span ``row, first, last, ...`` that covers them."""
    at = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH)))
    there = cells.withColumn("__stretch", F.floor(F.col("col") / STRETCH))
    return there.join(spans.withColumn("__stretch", at), ["row", "__stretch"]).where("col between first and last").drop("__stretch", "first", "last")


def zonal_histogram(cells: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """``zone, v, n``: statistics per zone without a clip being made."""
    return _met(cells, polygon_spans(polygons, grid)).groupBy("zone", "v").agg(F.count("*").alias("n"))


def extract(cells: DataFrame, polygons: DataFrame, grid: Grid, nodata: int = 0) -> DataFrame:
    """``zone, row, col, v``: a clip per polygon, its bounding box with ``nodata`` outside.

    Rows and columns stay those of the raster. Polygons that meet no cell give nothing.
    """
    inside = polygon_spans(polygons, grid).groupBy("zone", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # a row's crossings of one polygon
    # the box is that of the geometry, cut to whole cells
    xy = polygons.select("zone", F.explode(F.flatten("rings")).alias("p"))
    at = lambda v, o, r: (v - o) / r
    box = xy.groupBy("zone").agg(
        F.floor(F.min(at(F.lit(grid.y0), F.col("p.y"), grid.res_y))).alias("r0"), (F.ceil(F.max(at(F.lit(grid.y0), F.col("p.y"), grid.res_y))) - 1).alias("r1"),
        F.floor(F.min(at(F.col("p.x"), grid.x0, grid.res_x))).alias("first"), (F.ceil(F.max(at(F.col("p.x"), grid.x0, grid.res_x))) - 1).alias("last"),
    )
    if grid.rows is not None:
        box = box.withColumns({"r0": F.greatest("r0", F.lit(0)), "r1": F.least("r1", F.lit(grid.rows - 1))})
    if grid.cols is not None:
        box = box.withColumns({"first": F.greatest("first", F.lit(0)), "last": F.least("last", F.lit(grid.cols - 1))})
    box = box.where("r0 <= r1 and first <= last")
    boxes = box.select("zone", F.explode(F.sequence(F.col("r0").cast("int"), F.col("r1").cast("int"))).alias("row"), "first", "last")
    met = _met(cells, boxes.join(inside, ["zone", "row"], "left"))
    covered = F.exists("spans", lambda x: (F.col("col") >= x["first"]) & (F.col("col") <= x["last"]))
    return met.select("zone", "row", "col", F.when(covered, F.col("v")).otherwise(F.lit(nodata)).cast("short").alias("v"))
