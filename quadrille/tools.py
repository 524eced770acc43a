"""The tools as functions of rasters: check, compute, describe, and on request write files.

Each takes a :class:`Raster` or the path of a GeoTIFF and returns a :class:`Result`. What a tool
makes is written once as a table of the shared folder, which all that follows reads. With ``outdir`` the result is written there as
GeoTIFF, and with ``stat_files`` also its tables and a report.
"""

from __future__ import annotations

import os
import time
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import checks
from quadrille.functions import statistics as st
from quadrille.functions.mosaic import GROUP_NAMES, GROUPS, group_of, mosaic_group
from quadrille.functions.palettes import SCHEMES, palette
from quadrille.operators import change as ch
from quadrille.operators import morphology as mo
from quadrille.operators import patches as pt
from quadrille.operators import window as wi
from quadrille.operators import zonal as zo
from quadrille.operators.tiles import from_tiles, in_tiles, map_values
from quadrille.plans import report
from quadrille.session import cut
from quadrille.sources.geotiff import Header, read_geotiff, read_tiles, write_clips, write_geotiff
from quadrille.sources.vector import read_polygons, vector_crs

__all__ = ["Raster", "Result", "frag", "frag_stats", "frag_gray", "frag_gray_stats", "frag_change", "landmos", "landmos_stats", "spa", "spa_stats", "mspa", "mspa_stats", "acc", "acc_stats", "rss", "extract_by_polygon", "info", "citation", "get_tif_colormap"]

@dataclass
class Raster:
    """Cells ``row, col, v`` and what is known of the grid. ``tag``: how a result was made; ``tiles``:
    the same raster in tiles, where it comes in them."""

    cells: DataFrame
    header: Header
    name: str = "raster"
    tag: dict[str, object] | None = None
    tiles: DataFrame | None = None

    @property
    def data(self) -> DataFrame:
        """The tiles, or else the cells."""
        return self.cells if self.tiles is None else self.tiles

    @classmethod
    def open(cls, path: str, spark: SparkSession | None = None) -> Raster:
        spark = spark or SparkSession.getActiveSession()
        cells, h = read_geotiff(spark, path)
        if h.epsg is None:
            warnings.warn(f"{path} has no projection; areas are in pixels", UserWarning, stacklevel=2)
        return cls(cells, h, os.path.splitext(os.path.basename(path))[0], report.parse_tag(h.description), read_tiles(spark, path))

    def facts(self) -> dict[str, object]:
        """What two rasters must share to be compared."""
        h, t = self.header, self.tag or {}
        return {**t, "rows": h.rows, "cols": h.cols, "bands": h.bands, "res_x": h.res_x, "res_y": h.res_y, "epsg": h.epsg, "bounds": h.bounds}


@dataclass
class Result:
    """The raster that a tool made (None for tools that make none), its statistics by section, and the files written."""

    raster: Raster | None
    stats: dict[str, dict[str, object]] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)


def _raster(x: Raster | str) -> Raster:
    x = Raster.open(x) if isinstance(x, str) else x
    if x.header.bands != 1:
        raise checks.InputError(f"a raster has one band, not {x.header.bands}")
    return x


def _folder(outdir: str | None) -> None:
    if outdir is not None and not os.path.isdir(outdir):
        raise checks.InputError(f"{outdir} is not a folder")


def _row(df: DataFrame) -> dict[str, object]:
    return df.first().asDict()


def _made(src: Raster, cells: DataFrame, name: str, tool: str, nodata: int | None = None, scheme: str | None = None, **values: object) -> Raster:
    """The raster that a tool makes, as a table: the file, the statistics and the tables read it, and none makes it anew."""
    tag = report.make_tag(tool, **values)
    h = replace(src.header, dtype="uint8", bands=1, nodata=nodata, description=tag, software="quadrille", colormap=palette(scheme or tool))
    made = cut(cells, name)
    return Raster(from_tiles(made) if in_tiles(made) else made, h, name, report.parse_tag(tag), made if in_tiles(made) else None)


def _source(src: Raster, form: str, window: int) -> tuple[DataFrame, str]:
    """What a moving window reads, and its form: tiles all the way where the file's are large enough for the halo."""
    if form != "tile":
        return src.cells, form
    wide = src.tiles is not None and window // 2 <= src.header.block[0]
    return src.tiles if wide else src.cells, "tiles"


def _input(x: Raster, *sources: Raster | str | None) -> dict[str, object]:
    """What a report says of the input: files (n/a where a result alone is known) and grid."""
    h = x.header
    names = ["n/a" if s is None else _raster(s).name for s in sources]
    files = {"Input image": names[0]} if len(names) == 1 else {f"Input image {k}": n for k, n in zip("AB", names)}
    return {**files, "EPSG": h.epsg, "Unit": h.unit, "Pixel size (x,y)": f"{h.res_x}, {h.res_y}", "Rows": h.rows, "Columns": h.cols, "Total pixels": h.rows * h.cols}


def _finish(out: Raster | None, name: str, title: str, began: float, outdir: str | None, stats: dict | None, tables: dict[str, DataFrame] | None) -> Result:
    """Write what was asked for. ``stats`` None: none; ``tables`` None: no files of statistics."""
    files = {}
    if outdir is not None:
        base = os.path.join(outdir, name)
        if out is not None:
            write_geotiff(out.data, f"{base}.tif", out.header)
            files["tif"] = f"{base}.tif"
        if stats is not None and tables is not None:
            for k, t in tables.items():
                report.write_csv(t, f"{base}_{k}.csv", t.columns[0] if k != "triangle" else None)
                files[k] = f"{base}_{k}.csv"
            text = report.report_text(title, {"Run": {"Computational time": report.elapsed(time.monotonic() - began)}, **stats})
            with open(f"{base}.txt", "w", encoding="utf-8") as f:
                f.write(text)
            files["txt"] = f"{base}.txt"
    return Result(out, stats or {}, files)


def _wanted(x: Raster, tool: str, kind: str | None = None) -> dict[str, object]:
    if x.tag is None:
        raise checks.InputError(f"{x.name} does not say that a tool made it")
    if x.tag["tool"] != tool or (kind and x.tag.get("kind") != kind):
        raise checks.InputError(f"{x.name} was made by {x.tag['tool']} {x.tag.get('kind', '')}, not {tool} {kind or ''}")
    return x.tag


def _area(x: Raster, window: int) -> dict[str, object]:
    a = st.window_area(window, x.header.res_x, x.header.res_y, x.header.unit)
    return {f"window {k}": v for k, v in a.items()} if a else {"window cells": window * window}


# fragmentation ----------------------------------------------------------------------------


def frag(source: Raster | str, method: str, window_size: int, connectivity: int = 4, outdir: str | None = None, statists: bool = True, stat_files: bool = True, form: str = "tile") -> Result:
    """FAD, FAC or FED of a binary map (0-4)."""
    began = time.monotonic()
    checks.check_fragmentation(method, window_size, connectivity)
    _folder(outdir)
    src = _raster(source)
    checks.check_binary(src.data, special=True)
    name = f"{src.name}_frag_{method}{connectivity if method != 'FAD' else ''}_{window_size}"
    own, form = _source(src, form, window_size)
    cells = wi.fragmentation(own, method, window_size, connectivity, form=form)
    out = _made(src, cells, name, "frag", kind="Binary", threshold=-1, connectivity=connectivity, method=f"{method}_5", pixel=src.header.res_x, window=window_size)
    return _finish(out, name, f"Fragmentation {method}", began, outdir, _frag_sections(out, src) if statists else None, {"histogram": report.fragmentation_table(out.data)} if stat_files else None)


def _frag_sections(x: Raster, source: Raster | str | None) -> dict:
    t = x.tag
    return {"Input": _input(x, source), "Parameters": {**{k: v for k, v in t.items() if k != "tool"}, **_area(x, int(t["window"]))}, "Statistics": _row(st.fragmentation_stats(x.data))}


def frag_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    """Statistics of a result of :func:`frag`, whose parameters come from its tag. ``source``, here
    and in all ``*_stats``: the raster that the result was made from, for the report."""
    began, x = time.monotonic(), _raster(result)
    _wanted(x, "frag", "Binary")
    return _finish(None, x.name, "Fragmentation", began, outdir, _frag_sections(x, source), {"histogram": report.fragmentation_table(x.data)} if stat_files else None)


def frag_gray(source: Raster | str, method: str, window_size: int, for_threshold: int, connectivity: int = 4, outdir: str | None = None, statists: bool = True, stat_files: bool = True, form: str = "tile") -> Result:
    """FAD, FAC or FED of percent values; method names in any case."""
    began = time.monotonic()
    method = checks.check_gray(method, window_size, for_threshold, connectivity)
    _folder(outdir)
    src = _raster(source)
    checks.check_gray_cells(src.data)
    name = f"{src.name}_frag_{method}{connectivity if method != 'FAD' else ''}_{window_size}_t{for_threshold}"
    own, form = _source(src, form, window_size)
    cells = wi.fragmentation_gray(own, method, window_size, for_threshold, connectivity, form=form)
    out = _made(src, cells, name, "frag", kind="Gray", threshold=for_threshold, connectivity=connectivity, method=f"{method}_5", pixel=src.header.res_x, window=window_size)
    return _finish(out, name, f"Grayscale fragmentation {method}", began, outdir, _gray_sections(out, src) if statists else None, {"histogram": report.fragmentation_table(out.data)} if stat_files else None)


def _gray_sections(x: Raster, source: Raster | str | None) -> dict:
    out = _frag_sections(x, source)
    return out if source is None else out | {"Statistics": _row(st.gray_stats(_raster(source).data, x.data))}


def frag_gray_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    """Statistics of a result of :func:`frag_gray`; counts of the input need its ``source``."""
    began, x = time.monotonic(), _raster(result)
    _wanted(x, "frag", "Gray")
    return _finish(None, x.name, "Grayscale fragmentation", began, outdir, _gray_sections(x, source), {"histogram": report.fragmentation_table(x.data)} if stat_files else None)


def frag_change(before: Raster | str, after: Raster | str, outdir: str | None = None, statists: bool = True, stat_files: bool = True) -> Result:
    """Change between two results of one method on one grid."""
    began = time.monotonic()
    _folder(outdir)
    a, b = _raster(before), _raster(after)
    checks.check_change_pair(a.facts(), b.facts())
    cells, tab = ch.change(a.cells, b.cells), cut(ch.crosstab(a.cells, b.cells), "crosstab")
    tag = {k: v for k, v in a.tag.items() if k != "tool"}
    name = f"change_{a.name}_{b.name}"
    out = _made(a, cells, name, "change", 254, **tag)
    stats = None
    if statists:
        matrix = lambda g: {f"{r.ga} to {r.gb}": r.n for r in ch.aggregate_matrix(tab, g).collect()}  # noqa: E731  at most 49 rows
        stats = {"Input": _input(out, a, b), "Parameters": tag, "Statistics": _row(st.change_stats(tab)), "Connectivity indices": _row(st.change_differences(tab)), "Land": matrix(ch.LAND_GROUPS), "Classes": matrix(ch.CLASS_GROUPS)}
    return _finish(out, name, "Fragmentation change", began, outdir, stats, {"histogram": report.change_table(out.data)} if stat_files else None)


# mosaic -----------------------------------------------------------------------------------


def landmos(source: Raster | str, window_size: int, outdir: str | None = None, statists: bool = True, stat_files: bool = True, out_colors: str = "bgr", form: str = "tile") -> Result:
    """Landscape mosaic of 103 classes; the map of 19 groups is written beside it. ``out_colors``: one of six palettes."""
    began = time.monotonic()
    checks.check_window(window_size)
    if out_colors not in SCHEMES:
        raise checks.InputError(f"{out_colors!r} is not a colour scheme")
    _folder(outdir)
    src = _raster(source)
    checks.check_three_class(src.data)
    name = f"{src.name}_lm_{window_size}"
    own, form = _source(src, form, window_size)
    out = _made(src, wi.mosaic(own, window_size, form), name, "mosaic", 0, f"mosaic_{out_colors}", window=window_size, colors=out_colors)
    r = _finish(out, name, "Landscape mosaic", began, outdir, _mosaic_sections(out, src) if statists else None, _mosaic_tables(out) if stat_files else None)
    if outdir is not None:
        groups = map_values(out.tiles, np.array([group_of(v) if v in GROUPS else 0 for v in range(256)])) if out.tiles is not None else out.cells.select("row", "col", mosaic_group(F.col("v")).cast("short").alias("v"))
        r.files["tif_groups"] = os.path.join(outdir, f"{name}_groups.tif")
        write_geotiff(groups, r.files["tif_groups"], replace(out.header, description=report.make_tag("mosaic", window=window_size, colors="-"), colormap=palette("mosaic_groups")))
        if statists and stat_files:
            r.files["heatmap"] = os.path.join(outdir, f"{name}_heatmap.csv")
            report.write_heatmap(out.data, r.files["heatmap"], window_size)
    return r


def _mosaic_sections(x: Raster, source: Raster | str | None) -> dict:
    groups = {GROUP_NAMES.get(r.grp, "-"): r.pct for r in st.mosaic_groups(x.data).orderBy("grp").collect()}  # at most 19 rows
    return {"Input": _input(x, source), "Parameters": _area(x, int(x.tag["window"])) | {"window": x.tag["window"]}, "Statistics": _row(st.mosaic_stats(x.data)), "Groups": groups}


def _mosaic_tables(x: Raster) -> dict[str, DataFrame]:
    return {"histogram": report.mosaic_table(x.data), "triangle": report.ternary_table(x.data)}


def landmos_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    """Statistics of a mosaic of 103 classes (a map of groups is refused)."""
    began, x = time.monotonic(), _raster(result)
    if _wanted(x, "mosaic")["colors"] == "-":
        raise checks.InputError(f"{x.name} is a map of groups")
    return _finish(None, x.name, "Landscape mosaic", began, outdir, _mosaic_sections(x, source), _mosaic_tables(x) if stat_files else None)


# morphology and patches -------------------------------------------------------------------


def _plain(x: Raster, stats: DataFrame, source: Raster | str | None) -> dict:
    return {"Input": _input(x, source), "Parameters": {k: v for k, v in (x.tag or {}).items() if k != "tool"}, "Statistics": _row(stats)}


def spa(source: Raster | str, edge_width: int, classes: int = 6, outdir: str | None = None, statists: bool = True, stat_files: bool = True) -> Result:
    """Simplified morphological segmentation."""
    began = time.monotonic()
    checks.check_spa(edge_width, classes)
    _folder(outdir)
    src = _raster(source)
    checks.check_binary(src.data)
    name = f"{src.name}_spa_{edge_width}_{classes}"
    out = _made(src, mo.spa(src.data if src.tiles is None or 2 * edge_width + 4 <= src.header.block[0] else src.cells, edge_width, classes), name, "spa", 129, edge=edge_width, classes=classes)
    return _finish(out, name, "Simplified pattern analysis", began, outdir, _plain(out, st.spa_stats(out.data), src) if statists else None, {} if stat_files else None)


def spa_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    began, x = time.monotonic(), _raster(result)
    _wanted(x, "spa")
    return _finish(None, x.name, "Simplified pattern analysis", began, outdir, _plain(x, st.spa_stats(x.data), source), {} if stat_files else None)


def mspa(source: Raster | str, connectivity: int = 8, edge_width: int = 1, transition: bool = True, intext: bool = True, outdir: str | None = None, statists: bool = True, stat_files: bool = True) -> Result:
    """Morphological spatial pattern analysis. ``transition`` changes no cell: it is kept in the tag, and
    connectors that cross a rim get their own colour, or without it the rim's."""
    began = time.monotonic()
    checks.check_mspa(connectivity, edge_width)
    _folder(outdir)
    src = _raster(source)
    checks.check_binary(src.data)
    name = f"{src.name}_{connectivity}_{edge_width}_{int(transition)}_{int(intext)}"
    out = _made(src, mo.mspa(src.cells, connectivity, edge_width, intext), name, "mspa", 129, "mspa" if transition else "mspa_plain", connectivity=connectivity, edge=edge_width, transition=transition, intext=intext)
    return _finish(out, name, "Morphological spatial pattern analysis", began, outdir, _mspa_sections(out, src) if statists else None, {} if stat_files else None)


def _mspa_sections(x: Raster, source: Raster | str | None) -> dict:
    n = {r.v: r.n for r in st.histogram(x.data).collect()}  # at most 256 rows
    every = {k: {f"{name} ({c + add})": n.get(c + add, 0) for name, c in st.MSPA_CODES.items()} for k, add in (("External", 0), ("Internal", 100))}
    ground = {f"{name} ({c})": n.get(c, 0) for name, c in (("Background", 0), ("Border-Opening", 220), ("Core-Opening", 100), ("Missing data", 129))}
    return _plain(x, st.mspa_stats(x.data), source) | every | {"Background": ground}


def mspa_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    began, x = time.monotonic(), _raster(result)
    _wanted(x, "mspa")
    return _finish(None, x.name, "Morphological spatial pattern analysis", began, outdir, _mspa_sections(x, source), {} if stat_files else None)


def acc(source: Raster | str, thresholds: Iterable[int], outdir: str | None = None, statists: bool = True, stat_files: bool = True) -> Result:
    """Patches by size class."""
    began, t = time.monotonic(), checks.check_thresholds(thresholds)
    _folder(outdir)
    src = _raster(source)
    checks.check_binary(src.data, special=True)
    name = f"{src.name}_acc_{'_'.join(map(str, t))}"
    out = _made(src, pt.accounting(src.cells, t), name, "acc", 129, thresholds=t)
    stats = None
    if statists:
        rows = pt.accounting_stats(src.cells, t).orderBy("size_class").collect()  # at most six
        stats = {"Input": _input(out, src), "Parameters": {"thresholds": t}, **{f"Size class {r.size_class}": {k: v for k, v in r.asDict().items() if k != "size_class"} for r in rows}}
    return _finish(out, name, "Patch accounting", began, outdir, stats, {} if stat_files else None)


def acc_stats(result: Raster | str, outdir: str | None = None, stat_files: bool = True, source: Raster | str | None = None) -> Result:
    """Cells by size class of a result of :func:`acc`; it has no patches any more, so their counts are None."""
    began, x = time.monotonic(), _raster(result)
    t = _wanted(x, "acc")["thresholds"]
    n = {r.v: r.n for r in st.histogram(x.data).collect()}  # at most 256 rows
    codes = pt.SIZE_CODES[: len(t) + 1]
    total = sum(n.get(c, 0) for c in codes)
    stats = {"Input": _input(x, source), "Parameters": {"thresholds": t}, **{f"Size class {i}": {"code": c, "patches": None, "cells": n.get(c, 0), "cells_pct": 100 * n.get(c, 0) / total if total else 0.0} for i, c in enumerate(codes)}}
    return _finish(None, x.name, "Patch accounting", began, outdir, stats, {} if stat_files else None)


def rss(source: Raster | str, outdir: str | None = None, stat_files: bool = True) -> Result:
    """Restoration indices; makes no raster."""
    began, src = time.monotonic(), _raster(source)
    _folder(outdir)
    checks.check_binary(src.data, special=True)
    return _finish(None, f"{src.name}_rss", "Restoration status", began, outdir, {"Input": _input(src, src), "Statistics": _row(pt.restoration(src.cells))}, {} if stat_files else None)


# zones ------------------------------------------------------------------------------------


def extract_by_polygon(polygons: DataFrame | str, source: Raster | str, outdir: str | None, id_field: str = "zone", name_prefix: str = "", nodata_value: int | None = None, layer: str | None = None, form: str = "tif") -> DataFrame:
    """Clips ``zone, row, col, v``; with ``outdir`` a GeoTIFF a zone is written there, with the
    raster's tag and colours, or (``form`` parquet) a folder a zone.

    Coordinates are taken as they are: both must have the same projection, and a file must name
    its own. Polygons and a raster that have nothing in common are refused.
    """
    src = _raster(source)
    if src.header.epsg is None:
        raise checks.InputError(f"{src.name} has no defined projection")
    if form not in ("tif", "parquet"):
        raise checks.InputError(f"{form!r} is not tif or parquet")
    spark = src.cells.sparkSession
    if isinstance(polygons, str):
        if vector_crs(polygons, layer) is None:
            raise checks.InputError(f"{polygons} has no defined projection")
        polygons = read_polygons(spark, polygons, id_field, layer)
    zones = polygons.withColumn("zone", F.concat(F.lit(name_prefix), F.col("zone")))
    h = src.header
    fill = nodata_value if nodata_value is not None else zo.nodata_of((src.tag or {}).get("tool"), h.nodata)
    left, bottom, right, top = h.bounds
    p = zones.select(F.explode(F.flatten("rings")).alias("p")).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1")).first()
    if p.x0 is None or p.x0 >= right or p.x1 <= left or p.y0 >= top or p.y1 <= bottom:
        raise checks.InputError("the polygons and the raster do not overlap")
    clips = zo.extract(src.cells, zones, zo.Grid(h.x0, h.y0, h.res_x, h.res_y, h.rows, h.cols), fill)
    if outdir is not None and form == "tif":
        clips = cut(clips, "clips")
        write_clips(clips, outdir, replace(h, dtype="uint8", bands=1, nodata=None, software="quadrille"), fill)
    elif outdir is not None:
        clips.write.mode("overwrite").partitionBy("zone").parquet(outdir)
        clips = spark.read.parquet(outdir)
    return clips


# about ------------------------------------------------------------------------------------

ABOUT = {f.__name__: (f.__doc__ or "").split("\n")[0] for f in (frag, frag_gray, frag_change, landmos, spa, mspa, acc, rss, extract_by_polygon)}


def info(tool: str | None = None) -> str:
    """What there is, or what one tool does."""
    if tool is not None and tool not in ABOUT:
        raise checks.InputError(f"{tool!r} is not one of {', '.join(ABOUT)}")
    return "\n".join(f"{k}: {v}" for k, v in ABOUT.items() if tool in (None, k))


def citation() -> str:
    return "quadrille, a PySpark engine for raster pattern analysis. Please name the version and the tools that were used, with their parameters (the tag of a result has them)."


def get_tif_colormap(path: str) -> dict[int, tuple[int, int, int]]:
    """The palette of a file by value; empty if it has none."""
    from quadrille.sources.geotiff import read_header

    return read_header(path).colormap
