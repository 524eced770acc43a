"""Rasters as tiles, and the halo exchange that lets a kernel see beyond its tile.

A raster is a DataFrame of cells ``row INT, col INT, v SMALLINT`` or of tiles
``tr INT, tc INT, r0 INT, c0 INT, h INT, w INT, data BINARY`` (one byte a cell, row-major, 255
for a cell that isn't there). Kernels get dense arrays; one shuffle brings the halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import bounded_batches, cut

__all__ = ["ABSENT", "TILE", "BATCH", "over_tiles", "cut_tiles", "in_tiles", "to_tiles", "from_tiles", "tile_histogram", "map_values", "map_tiles", "TILE_SCHEMA"]

TILE = 512
#: A cell that isn't in the raster, in byte arrays.
ABSENT = 255
#: Bytes of tiles that a Python worker takes at a time, one tile at least: what it makes of them is several times as much.
BATCH = 2 << 20
#: Tiles of a file: executors read them together.
FILE = 16
TILE_SCHEMA = "tr int, tc int, r0 int, c0 int, h int, w int, data binary"


def _dense(rows: np.ndarray, cols: np.ndarray, v: np.ndarray, r0: int, c0: int, h: int, w: int) -> np.ndarray:
    a = np.full((h, w), ABSENT, np.uint8)
    a[rows - r0, cols - c0] = v
    return a


def over_tiles(tiles: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of few tiles, so that a worker's memory doesn't grow with the tiles of its task."""
    bounded_batches(tiles.sparkSession, rows=None)
    most = BATCH

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            step = max(1, most * n // max(1, b.nbytes))
            for at in range(0, n, step):
                yield b.slice(at, step)

    return tiles.mapInArrow(lambda batches: run(few(batches)), schema)


def cut_tiles(tiles: DataFrame, name: str = "tiles") -> DataFrame:
    """As :func:`quadrille.session.cut`, in files of few tiles."""
    return cut(tiles, name, FILE)


def in_tiles(raster: DataFrame) -> bool:
    """Whether a raster is in tiles already."""
    return "data" in raster.columns


def to_tiles(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells to tiles; values are 0 to 254. A cell stands once. A raster in tiles stays as it is, whatever their size."""
    if in_tiles(cells):
        return cells
    keyed = cells.select("row", "col", F.col("v").cast("int").alias("v"), F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        tr, tc = map(int, key)
        r0, c0 = tr * tile, tc * tile
        a = _dense(p["row"].to_numpy(), p["col"].to_numpy(), p["v"].to_numpy(), r0, c0, tile, tile)
        return pd.DataFrame({"tr": [tr], "tc": [tc], "r0": [r0], "c0": [c0], "h": [tile], "w": [tile], "data": [a.tobytes()]})

    return keyed.groupBy("tr", "tc").applyInPandas(pack, TILE_SCHEMA)


def from_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles to cells, without those that aren't there."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, c0, h, w, data in zip(*(b.column(c).to_pylist() for c in ("r0", "c0", "h", "w", "data"))):
                a = np.frombuffer(data, np.uint8).reshape(h, w)
                i, j = np.nonzero(a != ABSENT)
                yield pa.RecordBatch.from_arrays([pa.array((i + r0).astype(np.int32)), pa.array((j + c0).astype(np.int32)), pa.array(a[i, j].astype(np.int16))], names=["row", "col", "v"])

    return over_tiles(tiles, unpack, "row int, col int, v short")


def tile_histogram(tiles: DataFrame) -> DataFrame:
    """``v, n`` of the values that occur: a count of bytes a batch, and their sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        v = np.flatnonzero(n[:ABSENT])
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int16)), pa.array(n[v])], names=["v", "n"])

    return over_tiles(tiles.select("data"), count, "v short, n long").groupBy("v").agg(F.sum("n").alias("n"))


def map_values(tiles: DataFrame, lut: np.ndarray) -> DataFrame:
    """Tiles with each value looked up in a table of 256 bytes; cells that aren't there stay so."""
    lut = lut.astype(np.uint8)
    lut[ABSENT] = ABSENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [lut[np.frombuffer(x, np.uint8)].tobytes() for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w")), pa.array(data, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    return over_tiles(tiles.select("tr", "tc", "r0", "c0", "h", "w", "data"), run, TILE_SCHEMA)


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], halo: int, dtype: type = np.uint8, absent: int = ABSENT, spread: bool = False) -> DataFrame:
    """Apply ``kernel`` to every tile with ``halo`` cells around it; tiles in, tiles out.

    The kernel gets an array of ``(h + 2 halo, w + 2 halo)``, ``absent`` outside the raster, and
    returns one of ``(h, w)``; cells that are ABSENT stay so. Each tile sends itself to its own place
    and strips to its neighbours': one shuffle, of about ``1 + 4 halo / tile`` times the raster. Tiles must be on a regular
    grid and no smaller than the halo. ``spread``: as many tasks as the session has shuffle
    partitions, for kernels that are much work on few bytes, and not as few as the bytes fill.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tr", "tc", "own", "r0", "c0", "h", "w", "data"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for tr, tc, r0, c0, h, w, data in zip(*(b.column(c).to_pylist() for c in ("tr", "tc", "r0", "c0", "h", "w", "data"))):
                if halo > min(h, w):
                    raise ValueError(f"a halo of {halo} needs tiles of at least that size, not {h} by {w}")
                a = np.frombuffer(data, dtype).reshape(h, w)
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        ra, rz = (0, h) if i == 0 else (0, halo) if i < 0 else (h - halo, h)
                        ca, cz = (0, w) if j == 0 else (0, halo) if j < 0 else (w - halo, w)
                        if rz > ra and cz > ca:
                            for o, x in zip(out, (tr + i, tc + j, i == j == 0, r0 + ra, c0 + ca, rz - ra, cz - ca, a[ra:rz, ca:cz].tobytes())):
                                o.append(x)
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        own = p[p["own"]]
        if own.empty:  # no such tile: strips sent beyond the raster
            return pd.DataFrame({"tr": [], "tc": [], "r0": [], "c0": [], "h": [], "w": [], "data": []})
        o = own.iloc[0]
        r0, c0, h, w = int(o["r0"]), int(o["c0"]), int(o["h"]), int(o["w"])
        a = np.full((h + 2 * halo, w + 2 * halo), absent, dtype)
        for pr, pc_, ph, pw, data in zip(p["r0"], p["c0"], p["h"], p["w"], p["data"]):
            i, j = pr - r0 + halo, pc_ - c0 + halo
            a[i : i + ph, j : j + pw] = np.frombuffer(data, dtype).reshape(ph, pw)
        out = kernel(a).astype(dtype)
        if absent == ABSENT:
            out[a[halo : halo + h, halo : halo + w] == ABSENT] = ABSENT
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "r0": [r0], "c0": [c0], "h": [h], "w": [w], "data": [out.tobytes()]})

    sent = over_tiles(tiles, send, "tr int, tc int, own boolean, r0 int, c0 int, h int, w int, data binary")
    # a tile is few bytes and much work: as many tasks as the session asks for, not as few as the bytes fill
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "tr", "tc").groupBy("tr", "tc").applyInPandas(run, TILE_SCHEMA)
