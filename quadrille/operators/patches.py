"""Patch accounting by size class and restoration indices."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.checks import check_thresholds
from quadrille.operators.regions import Regions, regions
from quadrille.operators.tiles import TILE, from_tiles, to_tiles

__all__ = ["SIZE_CODES", "patches", "accounting", "accounting_stats", "restoration"]

#: Codes of size classes, smallest first, for the six that five thresholds make.
SIZE_CODES = (103, 33, 65, 1, 9, 17)


def patches(cells: DataFrame, targets: Iterable[int] = (2,), connectivity: int = 8, tile: int = TILE) -> Regions:
    """Regions of cells whose value is one of ``targets``, all targets as one class."""
    wanted = np.array(sorted(targets))
    return regions(to_tiles(cells, tile), lambda a: np.isin(a, wanted), connectivity)


def _class(size, thresholds: list[int]):
    out = F.lit(len(thresholds))
    for i in range(len(thresholds) - 1, -1, -1):
        out = F.when(size <= thresholds[i], i).otherwise(out)
    return out


def accounting(cells: DataFrame, thresholds: Iterable[int], tile: int = TILE) -> DataFrame:
    """``row, col, v``: each patch of foreground (2) gets the code of its size class.

    A patch belongs to the first threshold that its size does not exceed, the largest class
    otherwise. Background 0, missing 129, special classes 105 and 176.
    """
    t = check_thresholds(thresholds)
    found = patches(cells, tile=tile)
    values = found.sizes().select("region", _class(F.col("n"), t).alias("value"))
    codes = np.array(SIZE_CODES)

    def write(a: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.select([a == 255, value >= 0, a == 0, a == 3, a == 4], [255, codes[np.maximum(value, 0)], 129, 105, 176], 0)

    return from_tiles(found.paint(values, write))


def accounting_stats(cells: DataFrame, thresholds: Iterable[int], tile: int = TILE) -> DataFrame:
    """One row per size class (empty ones too): ``size_class, code, up_to, patches, cells,
    patches_pct, cells_pct``; ``up_to`` is null for the largest."""
    t = check_thresholds(thresholds)
    sizes = patches(cells, tile=tile).sizes()
    got = sizes.groupBy(_class(F.col("n"), t).cast("long").alias("size_class")).agg(F.count("*").alias("patches"), F.sum("n").alias("cells"))
    every = cells.sparkSession.range(len(t) + 1).select(F.col("id").alias("size_class"))
    total = got.agg(F.sum("patches").alias("p"), F.sum("cells").alias("c"))
    x = every.join(F.broadcast(got), "size_class", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    pct = lambda a, b: F.when(F.col(b) > 0, zero(F.col(a)) / F.col(b) * 100).otherwise(0.0)
    return x.select("size_class", F.get(F.array(*map(F.lit, SIZE_CODES)), F.col("size_class").cast("int")).alias("code"), F.get(F.array(*map(F.lit, t)), F.col("size_class").cast("int")).alias("up_to"), zero(F.col("patches")).alias("patches"), zero(F.col("cells")).alias("cells"), pct("patches", "p").alias("patches_pct"), pct("cells", "c").alias("cells_pct"))


def restoration(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """One row of restoration indices of foreground (2) in land (1 and 2).

    Patch count, mean, exact median and largest; RAC the share of foreground; ECA the root of
    the sum of squared sizes and COH its percentage of foreground; CNOA the odds ratio of
    connection (-9999 where undefined); RPOT what coherence lacks. ECA and CNOA are rounded half
    to even.
    """
    sizes = patches(cells, tile=tile).sizes()
    n = F.col("n").cast("double")
    s = sizes.agg(F.count("*").alias("patches"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("fg"), F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"), F.max("n").alias("largest"), F.sqrt(F.coalesce(F.sum(n * n), F.lit(0.0))).alias("eca_exact"))
    land = cells.agg(F.count(F.when(F.col("v") == 1, 1)).alias("background"))
    x = s.crossJoin(F.broadcast(land))
    fg, bg, eca = F.col("fg").cast("double"), F.col("background").cast("double"), F.col("eca_exact")
    low = fg * fg - eca * eca
    coh = F.when(fg > 0, eca / fg * 100).otherwise(0.0)
    return x.select(
        "patches", F.col("fg").alias("foreground"), "background", "mean_size", "median_size", "largest",
        F.when(fg + bg > 0, fg / (fg + bg) * 100).otherwise(0.0).alias("rac"), F.bround(eca).cast("long").alias("eca"), coh.alias("coh"),
        F.when(F.abs(low) < 1e-9, F.lit(-9999)).otherwise(F.bround(1 + 2 * fg * eca * eca / low)).cast("long").alias("cnoa"), (100 - coh).alias("rpot"),
    )
