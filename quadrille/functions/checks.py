"""Argument and domain checks; all raise :class:`InputError`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.tiles import in_tiles, tile_histogram

__all__ = ["InputError", "check_window", "check_fragmentation", "check_gray", "check_spa", "check_mspa", "check_thresholds", "check_domain", "check_binary", "check_gray_cells", "check_three_class", "check_change_pair"]


class InputError(ValueError):
    """A parameter or a raster that an operator does not take."""


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def check_window(window: int) -> None:
    if not _whole(window) or window < 3 or window % 2 == 0:
        raise InputError(f"the window's side must be an odd integer of at least 3, not {window!r}")


def check_fragmentation(method: str, window: int, connectivity: int) -> None:
    """Method names as they are written; connectivity does not matter for FAD."""
    check_window(window)
    if method not in ("FAD", "FAC", "FED"):
        raise InputError(f"method must be FAD, FAC or FED, not {method!r}")
    if method != "FAD" and connectivity not in (4, 8):
        raise InputError(f"connectivity must be 4 or 8, not {connectivity!r}")


def check_gray(method: str, window: int, threshold: int, connectivity: int) -> str:
    """As for binary maps, but the method in any case; returns it in upper case."""
    method = method.upper() if isinstance(method, str) else method
    check_fragmentation(method, window, connectivity)
    if not _whole(threshold) or not 1 <= threshold <= 100:
        raise InputError(f"the threshold must be an integer from 1 to 100, not {threshold!r}")
    return method


def check_spa(edge: int, classes: int) -> None:
    if not _whole(edge) or edge < 1:
        raise InputError(f"the edge width must be an integer of at least 1, not {edge!r}")
    if classes not in (2, 3, 5, 6):
        raise InputError(f"classes must be 2, 3, 5 or 6, not {classes!r}")


def check_mspa(connectivity: int, edge: int) -> None:
    if connectivity not in (4, 8):
        raise InputError(f"connectivity must be 4 or 8, not {connectivity!r}")
    if not _whole(edge) or edge < 1:
        raise InputError(f"the edge width must be an integer of at least 1, not {edge!r}")


def check_thresholds(thresholds: Iterable) -> list[int]:
    """One to five different positive integers, returned in order."""
    if isinstance(thresholds, str) or not hasattr(thresholds, "__iter__"):
        raise InputError("thresholds must be a list of integers")
    try:
        out = sorted({int(x) for x in thresholds})
    except (TypeError, ValueError) as e:
        raise InputError("thresholds must be integers") from e
    if not 1 <= len(out) <= 5 or out[0] <= 0:
        raise InputError("one to five different positive thresholds are needed")
    return out


def _values(cells: DataFrame) -> DataFrame:
    """The cells, or of a raster in tiles the values that occur."""
    if in_tiles(cells):
        return tile_histogram(cells)
    kind = cells.schema["v"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise InputError(f"a raster has integer values, not {kind}")
    return cells


def check_domain(cells: DataFrame, needed: set[int], allowed: set[int]) -> None:
    """All needed values occur and no others than the allowed: one pass, two flags a needed value."""
    cells = _values(cells)
    present = [F.coalesce(F.max(F.col("v") == k), F.lit(False)).alias(f"p{k}") for k in sorted(needed)]
    row = cells.agg(F.max(~F.col("v").isin(*sorted(allowed))).alias("other"), F.max(F.col("v").isNull()).alias("nulls"), *present).first()
    if lacking := [k for k in sorted(needed) if not row[f"p{k}"]]:
        raise InputError(f"values {lacking} are missing")
    if row["other"] or row["nulls"]:
        raise InputError(f"only values {sorted(allowed)} are allowed")


def check_binary(cells: DataFrame, special: bool = False) -> None:
    check_domain(cells, {1, 2}, {0, 1, 2, 3, 4} if special else {0, 1, 2})


def check_three_class(cells: DataFrame) -> None:
    check_domain(cells, {1, 2, 3}, {0, 1, 2, 3})


def check_gray_cells(cells: DataFrame) -> None:
    """Some cell has an intensity; values below 0 are errors, those over 100 no data."""
    row = _values(cells).agg(F.max(F.col("v").between(1, 100)).alias("some"), F.max(F.col("v") < 0).alias("below")).first()
    if not row["some"]:
        raise InputError("no cell has a value from 1 to 100")
    if row["below"]:
        raise InputError("values below 0 are not allowed")


def check_change_pair(a: dict, b: dict) -> None:
    """Two fragmentation results of one method on one grid."""
    for m in (a, b):
        if m.get("tool") != "frag":
            raise InputError("both rasters must be fragmentation results")
    for k in ("kind", "connectivity", "method", "window", "threshold", "pixel", "rows", "cols", "bands", "res_x", "res_y", "epsg", "bounds"):
        if a.get(k) != b.get(k):
            raise InputError(f"the two rasters differ in {k}: {a.get(k)!r} and {b.get(k)!r}")
