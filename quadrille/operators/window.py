"""Moving-window density, clustering and edge metrics, and the three-pole landscape mosaic.

Every metric is a ratio of sums over rectangles round a cell. Both physical forms compute the
same sums: the *cell* form as two chained window aggregates (columns, then rows), the *tile*
form as differences of a summed-area table per tile, with a halo from the neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.checks import check_fragmentation, check_gray, check_window
from quadrille.functions.mosaic import mosaic_code, mosaic_codes
from quadrille.operators.tiles import ABSENT, TILE, from_tiles, in_tiles, map_tiles, map_values, to_tiles

__all__ = ["fragmentation", "fragmentation_gray", "mosaic", "kernel_fragmentation", "kernel_gray", "kernel_mosaic"]

Frame = tuple[int, int]


def pair_frames(r: int, connectivity: int) -> dict[str, tuple[Frame, Frame]]:
    """Column and row frames of each kind of neighbour pair, anchored at its upper or left cell
    (the upper right one where the pair runs down to the left)."""
    out = {"right": ((-r, r - 1), (-r, r)), "down": ((-r, r), (-r, r - 1))}
    if connectivity == 8:
        out |= {"se": ((-r, r - 1), (-r, r - 1)), "sw": ((1 - r, r), (-r, r - 1))}
    return out


def pairs_possible(w: int, connectivity: int) -> int:
    """Neighbour pairs in a whole window."""
    return 2 * w * (w - 1) if connectivity == 4 else 2 * (w - 1) * (2 * w - 1)


def _by_row() -> Window:
    return Window.partitionBy("row").orderBy("col")


def _by_col() -> Window:
    return Window.partitionBy("col").orderBy("row")


def rectangle_sums(cells: DataFrame, indicators: dict[str, tuple[Column, Frame, Frame]]) -> DataFrame:
    """Add, for each name, the sum of a cell indicator over a rectangle of column and row offsets.

    Range frames leave absent cells out by themselves. Two shuffles: by col, then by row.
    """
    by_col, by_row = _by_col(), _by_row()
    own = cells.columns
    x = cells.select("*", *[e.cast("long").alias(f"__{n}") for n, (e, _, _) in indicators.items()])
    x = x.select(*own, *[F.sum(f"__{n}").over(by_col.rangeBetween(*v)).alias(f"__{n}") for n, (_, _, v) in indicators.items()])
    return x.select(*own, *[F.coalesce(F.sum(f"__{n}").over(by_row.rangeBetween(*h)), F.lit(0)).alias(n) for n, (_, h, _) in indicators.items()])


def neighbours(cells: DataFrame, connectivity: int) -> DataFrame:
    """Add the values right, down and, for 8, se and sw of each cell; null where there is none."""
    by_row, by_col = _by_row(), _by_col()
    at = lambda c, w, k: F.max(c).over(w.rangeBetween(k, k))  # noqa: E731  the value at exactly that distance
    x = cells.withColumn("right", at("v", by_row, 1))
    if connectivity == 8:
        x = x.withColumn("left", at("v", by_row, -1))
        x = x.withColumns({"down": at("v", by_col, 1), "se": at("right", by_col, 1), "sw": at("left", by_col, 1)}).drop("left")
    else:
        x = x.withColumn("down", at("v", by_col, 1))
    return x


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative longs, exact at any size."""
    return ((a - a % b) / b).cast("long")


def _percent(n: Column, d: Column, unit: int) -> Column:
    value = _div(n * unit + d, F.when(d == 0, 1).otherwise(2 * d))
    return F.when(d == 0, 102).otherwise(F.least(value, F.lit(100)))


def fragmentation(cells: DataFrame, method: str, window: int, connectivity: int = 4, fixed: bool = False, form: str = "cell", tile: int = TILE) -> DataFrame:
    """FAD, FAC or FED of a binary map (0 missing, 1 background, 2 foreground, 3 and 4 special).

    Foreground cells get 0-100: FAD the share of foreground among cells that are neither missing
    nor 4; FAC the share of neighbour pairs that are both foreground; FED the same with half a
    pair for one foreground cell. 101 background, 102 missing or nothing to count, 105 and 106
    the special classes. ``fixed``: the denominator is that of a whole window. Windows are
    clamped at the raster's edge. Returns ``row, col, v``. Forms, here and below: ``cell`` by window
    aggregates of Spark, ``tile`` by summed areas of tiles, ``tiles`` the same with a result in tiles.
    The latter two also take a raster in tiles.
    """
    check_fragmentation(method, window, connectivity)
    r = window // 2
    if form != "cell":
        return _shown(map_tiles(to_tiles(cells, tile), kernel_fragmentation(method, window, connectivity, fixed), r, spread=True), form)
    v = F.col("v")
    cells = cells.select("row", "col", "v")
    if method == "FAD":
        whole = ((-r, r), (-r, r))
        x = rectangle_sums(cells, {"n": ((v == 2).cast("int"), *whole), "d": ((~v.isin(0, 4)).cast("int"), *whole)})
        unit, n, d, most = 200, F.col("n"), F.col("d"), window * window
    else:
        frames = pair_frames(r, connectivity)
        both = lambda o: F.coalesce((v == 2) & (F.col(o) == 2), F.lit(False)).cast("int")
        valid = lambda o: F.coalesce(~v.isin(0, 4) & ~F.col(o).isin(0, 4), F.lit(False)).cast("int")
        ones = lambda o: F.when(valid(o) == 1, (v == 2).cast("int") + (F.col(o) == 2).cast("int")).otherwise(0)
        ind = {f"n_{o}": ((both if method == "FAC" else ones)(o), *f) for o, f in frames.items()} | {f"d_{o}": (valid(o), *f) for o, f in frames.items()}
        x = rectangle_sums(neighbours(cells, connectivity), ind)
        add = lambda p: sum((F.col(f"{p}_{o}") for o in frames), F.lit(0))
        unit, n, d, most = 200 if method == "FAC" else 100, add("n"), add("d"), pairs_possible(window, connectivity)
    metric = _percent(n, F.lit(most).cast("long") if fixed else d, unit)
    code = F.when(v == 2, metric).when(v == 1, 101).when(v == 3, 105).when(v == 4, 106).otherwise(102)
    return x.select("row", "col", code.cast("short").alias("v"))


def fragmentation_gray(cells: DataFrame, method: str, window: int, threshold: int, connectivity: int = 4, fixed: bool = False, form: str = "cell", tile: int = TILE) -> DataFrame:
    """FAD, FAC or FED of percent values 0-100 (others are no data).

    Only cells of at least ``threshold`` are measured (others 101, no data 102); their
    neighbours count with their raw values, whatever the threshold. FAC counts pairs of which
    both are above 0, FED all. Method names in any case. Returns ``row, col, v``.
    """
    method = check_gray(method, window, threshold, connectivity)
    r = window // 2
    if in_tiles(cells):
        cells = map_values(cells, np.minimum(np.arange(256), 101))
    else:
        cells = cells.select("row", "col", F.when(F.col("v").between(0, 100), F.col("v")).otherwise(101).cast("short").alias("v"))
    if form != "cell":
        return _shown(map_tiles(to_tiles(cells, tile), kernel_gray(method, window, threshold, connectivity, fixed), r, spread=True), form)
    v = F.col("v")
    if method == "FAD":
        whole = ((-r, r), (-r, r))
        x = rectangle_sums(cells, {"n": (F.when(v <= 100, v).otherwise(0), *whole), "d": ((v <= 100).cast("int"), *whole)})
        unit, n, d, scale, most = 200, F.col("n"), F.col("d"), 100, window * window
    else:
        frames = pair_frames(r, connectivity)
        valid = lambda o: F.coalesce((v <= 100) & (F.col(o) <= 100), F.lit(False))
        counts = lambda o: valid(o) & (v > 0) & (F.col(o) > 0) if method == "FAC" else valid(o)
        ind = {f"n_{o}": (F.when(counts(o), v + F.col(o)).otherwise(0), *f) for o, f in frames.items()} | {f"d_{o}": (valid(o).cast("int"), *f) for o, f in frames.items()}
        x = rectangle_sums(neighbours(cells, connectivity), ind)
        add = lambda p: sum((F.col(f"{p}_{o}") for o in frames), F.lit(0))
        unit, n, d, scale, most = 200, add("n"), add("d"), 200, pairs_possible(window, connectivity)
    metric = _percent(n, F.lit(scale * most).cast("long") if fixed else d * scale, unit)
    code = F.when(v > 100, 102).when(v < threshold, 101).otherwise(metric)
    return x.select("row", "col", code.cast("short").alias("v"))


def mosaic(cells: DataFrame, window: int, form: str = "cell", tile: int = TILE) -> DataFrame:
    """Landscape mosaic of three classes (1 agriculture, 2 natural, 3 developed; 0 no data).

    Each cell with data gets the code of its window's shares among 103 classes. No data is 0.
    """
    check_window(window)
    r = window // 2
    if form != "cell":
        return _shown(map_tiles(to_tiles(cells, tile), kernel_mosaic(window), r, spread=True), form)
    whole = ((-r, r), (-r, r))
    x = rectangle_sums(cells.select("row", "col", "v"), {f"n{k}": ((F.col("v") == k).cast("int"), *whole) for k in (1, 2, 3)})
    return x.select("row", "col", F.when(F.col("v") == 0, 0).otherwise(mosaic_code(F.col("n1"), F.col("n2"), F.col("n3"))).cast("short").alias("v"))


def _shown(tiles: DataFrame, form: str) -> DataFrame:
    return tiles if form == "tiles" else from_tiles(tiles)


# tile form ---------------------------------------------------------------------------------


def box(x: np.ndarray, r: int, cols: Frame, rows: Frame) -> np.ndarray:
    """Sums of ``x`` over a rectangle of offsets round every cell but a rim of ``r``."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(x, axis=0, dtype=np.int64), axis=1, out=s[1:, 1:])
    h, w = x.shape[0] - 2 * r, x.shape[1] - 2 * r
    top, bottom, left, right = r + rows[0], r + rows[1] + 1, r + cols[0], r + cols[1] + 1
    cut = lambda i, j: s[i : i + h, j : j + w]
    return cut(bottom, right) - cut(top, right) - cut(bottom, left) + cut(top, left)


def _shifted(a: np.ndarray, kind: str) -> np.ndarray:
    dr, dc = {"right": (0, 1), "down": (1, 0), "se": (1, 1), "sw": (1, -1)}[kind]
    out = np.full_like(a, ABSENT)
    rows = slice(0, a.shape[0] - dr), slice(dr, a.shape[0])
    cols = (slice(0, a.shape[1] - dc), slice(dc, None)) if dc >= 0 else (slice(1, None), slice(0, -1))
    out[rows[0], cols[0]] = a[rows[1], cols[1]]
    return out


def _percent_array(n: np.ndarray, d: np.ndarray, unit: int) -> np.ndarray:
    return np.where(d == 0, 102, np.minimum((n * unit + d) // np.maximum(2 * d, 1), 100))


def kernel_fragmentation(method: str, window: int, connectivity: int, fixed: bool) -> Callable[[np.ndarray], np.ndarray]:
    r = window // 2

    def run(a: np.ndarray) -> np.ndarray:
        valid, fg, whole = (a != 0) & (a != 4) & (a != ABSENT), a == 2, ((-r, r), (-r, r))
        if method == "FAD":
            n, d, unit, most = box(fg, r, *whole), box(valid, r, *whole), 200, window * window
        else:
            n = d = 0
            for kind, frames in pair_frames(r, connectivity).items():
                b = _shifted(a, kind)
                ok = valid & (b != 0) & (b != 4) & (b != ABSENT)
                n = n + box(fg & (b == 2) if method == "FAC" else ok * (fg.astype(np.int8) + (b == 2)), r, *frames)
                d = d + box(ok, r, *frames)
            unit, most = 200 if method == "FAC" else 100, pairs_possible(window, connectivity)
        metric = _percent_array(n, np.full_like(d, most) if fixed else d, unit)
        own = a[r:-r, r:-r]
        return np.select([own == 2, own == 1, own == 3, own == 4], [metric, 101, 105, 106], 102)

    return run


def kernel_gray(method: str, window: int, threshold: int, connectivity: int, fixed: bool) -> Callable[[np.ndarray], np.ndarray]:
    r = window // 2

    def run(a: np.ndarray) -> np.ndarray:
        valid, value, whole = a <= 100, a.astype(np.int64), ((-r, r), (-r, r))
        if method == "FAD":
            n, d, most = box(np.where(valid, value, 0), r, *whole), 100 * box(valid, r, *whole), 100 * window * window
        else:
            n = d = 0
            for kind, frames in pair_frames(r, connectivity).items():
                b = _shifted(a, kind)
                ok = valid & (b <= 100)
                counts = ok & (a > 0) & (b > 0) if method == "FAC" else ok
                n = n + box(np.where(counts, value + b, 0), r, *frames)
                d = d + 200 * box(ok, r, *frames)
            most = 200 * pairs_possible(window, connectivity)
        metric = _percent_array(n, np.full_like(d, most) if fixed else d, 200)
        own = a[r:-r, r:-r]
        return np.select([own > 100, own < threshold], [102, 101], metric)

    return run


def kernel_mosaic(window: int) -> Callable[[np.ndarray], np.ndarray]:
    r = window // 2

    def run(a: np.ndarray) -> np.ndarray:
        n1, n2, n3 = (box(a == k, r, (-r, r), (-r, r)) for k in (1, 2, 3))
        return np.where(a[r:-r, r:-r] == 0, 0, mosaic_codes(n1, n2, n3))

    return run
