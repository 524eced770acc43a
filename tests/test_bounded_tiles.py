"""What a Python worker holds of tiles doesn't grow with the tiles of its task."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_kernels import cells, grid

from quadrille.operators import morphology as mo
from quadrille.operators.regions import regions
from quadrille.operators.tiles import TILE_SCHEMA


def test_a_worker_labels_few_tiles_at_a_time(spark):
    """48 tiles of 0.5 MB in one task; their labels alone are 48 MB."""

    def make(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                ints = [pa.array([x], pa.int32()) for x in (k, 0, k * 512, 0, 512, 512)]
                a = np.zeros((512, 512), np.uint16)
                a[5:9, k] = 1
                yield pa.RecordBatch.from_arrays([*ints, pa.array([a.tobytes()], pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    calls = []

    def mask(a):
        if not calls:
            tracemalloc.start()
        calls.append(tracemalloc.get_traced_memory()[0])
        if len(calls) == 48:
            tracemalloc.stop()
            if max(calls) > 24e6:
                raise MemoryError(f"{max(calls) / 1e6:.0f} MB of tiles are held")
        return a == 1

    tiles = spark.range(0, 48, 1, 1).mapInArrow(make, TILE_SCHEMA)
    found = regions(tiles, mask, 8, dtype=np.uint16).sizes().collect()
    assert sorted((r.region >> 32, r.region & 511, r.n) for r in found) == [(k * 512 + 5, k, 4) for k in range(48)]


def test_regions_finished_alone_and_together(spark, monkeypatch):
    """Bridges and dead ends in many tasks, long ones alone, are what they are in one task."""
    a = np.ones((60, 70), int)
    for k in range(3):
        a[20 * k + 2 : 20 * k + 10, 3:11] = a[20 * k + 2 : 20 * k + 10, 55:63] = 2
        a[20 * k + 5, 11:55] = 2
        a[20 * k + 5 : 20 * k + 17, 20 + 9 * k] = 2
    one = grid(mo.mspa(cells(spark, a), 8, 1, intext=False), a.shape)
    monkeypatch.setattr(mo, "SHARE", 12)
    assert (grid(mo.mspa(cells(spark, a), 8, 1, intext=False), a.shape) == one).all()
    assert {33, 35, 1} <= set(np.unique(one))


def test_tables_of_tiles_are_files_of_few_tiles(spark):
    """Executors read thousands of rows of a file at once, with all their bytes."""
    tiles = spark.range(0, 200, 1, 1).selectExpr("cast(id as int) tr", "0 tc", "cast(id * 8 as int) r0", "0 c0", "8 h", "8 w", "cast(repeat('a', 64) as binary) data")
    found = regions(tiles, lambda a: a > 0, 8)
    files = found.tiles.groupBy(F.input_file_name()).count().collect()
    assert sum(f["count"] for f in files) == 200 and max(f["count"] for f in files) <= 20
    assert [(r.region, r.n) for r in found.sizes().collect()] == [(0, 200 * 64)]


def test_regions_that_begin_left_of_the_map_stay_apart(spark):
    """An islet and a core at the left border, which both go on in the frame, in columns below 0."""
    a = np.ones((30, 20), int)
    a[2:11, 0:9] = a[20, 0] = 2
    for got in (mo.spa(cells(spark, a), 1, 6), mo.mspa(cells(spark, a), 8, 1)):
        got = grid(got, a.shape)
        assert got[5, 4] == 17 and got[20, 0] == 9
