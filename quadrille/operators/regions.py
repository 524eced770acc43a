"""Connected regions of rasters in tiles: labels, sizes, reachability, holes.

Each tile labels its own regions (runs of cells in rows, linked); only cells at tile borders are
compared across tiles, and the resulting small graph is solved by
:func:`quadrille.operators.components.connected_components`. A region's id is the place of its
first cell, ``(row << 32) + col``; columns may be negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.components import connected_components
from quadrille.operators.tiles import TILE_SCHEMA, cut_tiles, over_tiles
from quadrille.session import cut

__all__ = ["label_array", "Regions", "regions", "reach"]

Mask = Callable[[np.ndarray], np.ndarray]


def label_array(mask: np.ndarray, connectivity: int) -> tuple[np.ndarray, int]:
    """Labels 1..n of the regions of a mask, numbered by first cell; 0 elsewhere.

    Runs of cells are linked to those that they touch in the next row; each link hooks the larger
    root to the smaller one, and roots jump to their roots, until no link is left open.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # runs [start, end), row by row
    n, out = len(row), np.zeros((h, w), np.int32)
    if not n:
        return out, 0
    more, wide = (1 if connectivity == 8 else 0), w + 3
    first = np.searchsorted(row * wide + end, (row + 1) * wide + start - more, side="right")
    count = np.maximum(np.searchsorted(row * wide + start, (row + 1) * wide + end + more, side="left") - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count - first, count)
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not ((up := root[root]) == root).all():
            root = up
    roots, number = np.unique(root, return_inverse=True)
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(row * w + start, size)
    out.ravel()[at] = np.repeat(number + 1, size)
    return out, len(roots)


class Regions:
    """Labelled tiles and the regions that their local labels belong to.

    ``tiles`` has the tile columns and ``labels`` (32-bit, as bytes); ``parts`` one row per tile
    and local label: ``tr, tc, label, gid, n`` (cells) and ``seed`` (it holds a seed cell), and
    ``region``, the id of the whole region.
    """

    def __init__(self, tiles: DataFrame, parts: DataFrame, dtype: type = np.uint8) -> None:
        self.tiles, self.parts, self.dtype = tiles, parts, dtype

    def sizes(self) -> DataFrame:
        """``region, n``."""
        return self.parts.groupBy("region").agg(F.sum("n").cast("long").alias("n"))

    def paint(self, values: DataFrame, write: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """New tiles: ``write(data, value)`` gets each cell's value, from ``values(region, value)``,
        -1 where there is none."""
        own = self.parts.join(values, "region").groupBy("tr", "tc").agg(F.collect_list(F.struct("label", F.col("value").cast("long").alias("value"))).alias("values"))
        dtype = self.dtype
        rows = self.tiles.join(own, ["tr", "tc"], "left").select("tr", "tc", "r0", "c0", "h", "w", "data", "labels", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for h, w, data, labels, values in zip(*(b.column(c).to_pylist() for c in ("h", "w", "data", "labels")), b.column("values")):
                    lab = np.frombuffer(labels, np.int32).reshape(h, w)
                    lut = np.full(int(lab.max(initial=0)) + 1, -1, np.int64)
                    if values.is_valid:
                        lut[values.values.field("label").to_numpy()] = values.values.field("value").to_numpy()
                    out.append(write(np.frombuffer(data, dtype).reshape(h, w), lut[lab]).astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w")), pa.array(out, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

        return over_tiles(rows, run, TILE_SCHEMA)


def regions(tiles: DataFrame, mask: Mask, connectivity: int = 8, seeds: Callable[[np.ndarray, int, int], np.ndarray] | None = None, dtype: type = np.uint8) -> Regions:
    """Regions of the cells that ``mask(data)`` picks; ``seeds(data, r0, c0)`` marks seed cells."""
    def lists(tables: list[list[np.ndarray]], names: list[str]) -> pa.ListArray:
        """One list of structs a table; without an object a row."""
        columns = [pa.array(np.concatenate(c)) for c in zip(*tables)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t[0]) for t in tables)]), pa.int32()), pa.StructArray.from_arrays(columns, names))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            labels, parts, rim = [], [], []
            for tr, tc, r0, c0, h, w, data in zip(*(b.column(c).to_pylist() for c in ("tr", "tc", "r0", "c0", "h", "w", "data"))):
                a = np.frombuffer(data, dtype).reshape(h, w)
                lab, n = label_array(mask(a), connectivity)
                flat = lab.ravel()
                first = np.full(n + 1, h * w, np.int64)
                at = np.flatnonzero(flat)
                np.minimum.at(first, flat[at], at)
                gid = ((r0 + first // w) << 32) + (c0 + first % w)
                count = np.bincount(flat, minlength=n + 1)
                seed = np.zeros(n + 1, bool)
                if seeds is not None:
                    seed[np.unique(lab[seeds(a, r0, c0)])] = True
                labels.append(lab.tobytes())
                parts.append([np.arange(1, n + 1, dtype=np.int32), gid[1:], count[1:], seed[1:]])
                on = np.zeros((h, w), bool)
                on[0] = on[-1] = True
                on[:, 0] = on[:, -1] = True
                i, j = np.nonzero(on & (lab > 0))
                rim.append([(r0 + i).astype(np.int32), (c0 + j).astype(np.int32), gid[lab[i, j]]])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w", "data")), pa.array(labels, pa.binary()), lists(parts, ["label", "gid", "n", "seed"]), lists(rim, ["row", "col", "gid"])], names=["tr", "tc", "r0", "c0", "h", "w", "data", "labels", "parts", "rim"])

    done = cut_tiles(over_tiles(tiles.select("tr", "tc", "r0", "c0", "h", "w", "data"), local, f"{TILE_SCHEMA}, labels binary, parts array<struct<label:int,gid:long,n:long,seed:boolean>>, rim array<struct<row:int,col:int,gid:long>>"), "regions")
    parts = done.select("tr", "tc", F.explode("parts").alias("p")).select("tr", "tc", "p.label", "p.gid", "p.n", "p.seed")
    rim = done.select("tr", "tc", F.explode("rim").alias("x")).select("tr", "tc", "x.row", "x.col", "x.gid")
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    ahead = rim.select("tr", "tc", "gid", F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in steps])).alias("to")).select(F.col("tr").alias("tr1"), F.col("tc").alias("tc1"), F.col("gid").alias("a"), "to.row", "to.col")
    links = cut(ahead.join(rim, ["row", "col"]).where("tr <> tr1 or tc <> tc1").select("a", F.col("gid").alias("b")).where("a <> b").distinct(), "links")
    if links.isEmpty():  # every region lies in one tile
        whole = parts.withColumn("region", F.col("gid"))
    else:
        roots = connected_components(links).withColumnsRenamed({"node": "gid", "root": "region"})
        whole = parts.join(roots, "gid", "left").withColumn("region", F.coalesce("region", "gid"))
    return Regions(done.drop("parts", "rim"), whole.select("tr", "tc", "label", "gid", "n", "seed", "region"), dtype)


def reach(tiles: DataFrame, mask: Mask, seeds: Callable[[np.ndarray, int, int], np.ndarray], write: Callable[[np.ndarray, np.ndarray], np.ndarray], connectivity: int = 8, dtype: type = np.uint8) -> DataFrame:
    """New tiles: ``write(data, reached)`` is told which cells of the mask share a region with a seed."""
    found = regions(tiles, mask, connectivity, seeds, dtype)
    touched = found.parts.groupBy("region").agg(F.max("seed").alias("s")).where("s").select("region", F.lit(1).alias("value"))
    return cut_tiles(found.paint(touched, lambda data, value: write(data, value == 1)))
