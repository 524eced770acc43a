"""Throughput of the tools on one large raster, from file to file: ``python bench_large.py [side [tool ...]]``.

The raster is made by a rule (patches of several sizes, noise, missing cells) and written as a
GeoTIFF first. One JSON line with megapixels a second on ``local[$BENCH_CPUS]``.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

import numpy as np
import pyarrow as pa


def tiles_of_rule(spark, side: int, tile: int = 256):
    from quadrille.operators.tiles import ABSENT, TILE_SCHEMA

    across = -(-side // tile)

    def make(batches):
        for b in batches:
            cols = [[] for _ in range(7)]
            for k in b.column(0).to_pylist():
                r0, c0 = k // across * tile, k % across * tile
                r, c = np.arange(r0, r0 + tile)[:, None], np.arange(c0, c0 + tile)[None, :]
                wave = np.sin(r / 37) * np.cos(c / 53) + np.sin((r + 2 * c) / 191) + np.sin((2 * r - c) / 11) / 3
                a = np.where(wave > 0, 2, 1).astype(np.uint8)
                a[np.random.default_rng(k).random(a.shape) < 0.01] = 1
                a[(r % 997 < 3) & (c % 1009 < 40)] = 0
                a[(r >= side) | (c >= side)] = ABSENT
                for o, x in zip(cols, (k // across, k % across, r0, c0, tile, tile, a.tobytes())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in cols[:6]), pa.array(cols[6], pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    return spark.range(across * across).mapInArrow(make, TILE_SCHEMA)


def rates(spark, side: int, names=None) -> dict:
    """Seconds and megapixels a second of each tool on one raster of ``side`` cells a side (local mode alone)."""
    from quadrille import tools
    from quadrille.sources.geotiff import Header, write_geotiff

    out, took = tempfile.mkdtemp(prefix="bench-"), {}
    path = f"{out}/in.tif"
    write_geotiff(tiles_of_rule(spark, side), path, Header(side, side, res_x=100, res_y=100, epsg=3035, unit="metres"))
    runs = {
        "frag_fad_27": lambda: tools.frag(path, "FAD", 27, outdir=out, stat_files=False),
        "frag_fac8_27": lambda: tools.frag(path, "FAC", 27, 8, outdir=out, stat_files=False),
        "spa_1": lambda: tools.spa(path, 1, outdir=out, stat_files=False),
        "acc": lambda: tools.acc(path, [100, 10_000], outdir=out, stat_files=False),
        "mspa_8_1": lambda: tools.mspa(path, 8, 1, outdir=out, stat_files=False),
    }
    for name in names or runs:
        began = time.monotonic()
        runs[name]()
        took[name] = round(time.monotonic() - began, 1)
        print(f"{name}: {took[name]} s, {side * side / 1e6 / took[name]:.2f} Mpixel/s", file=sys.stderr, flush=True)
    shutil.rmtree(out)
    return {"megapixels": side * side / 1e6, "seconds": took, "megapixels_a_second": {k: round(side * side / 1e6 / v, 2) for k, v in took.items()}}


def main() -> None:
    from pyspark.sql import SparkSession

    side, cpus = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000, os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "64").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps({"metric": "megapixels_a_second", "cpus": int(cpus), **rates(spark, side, sys.argv[2:])}))


if __name__ == "__main__":
    main()
