"""Rasters that stay in tiles from file to file, against their cells."""

import numpy as np
import pytest
from test_kernels import cells, grid
from test_sources import stripped

from quadrille import tools as T
from quadrille.functions import statistics as st
from quadrille.functions.checks import InputError, check_binary, check_gray_cells
from quadrille.operators import morphology as mo
from quadrille.operators import window as wi
from quadrille.operators.regions import label_array
from quadrille.operators.tiles import from_tiles, in_tiles, to_tiles
from quadrille.sources.geotiff import Header, read_geotiff, read_tiles, write_geotiff


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, (150, 210))
    path = str(tmp_path_factory.mktemp("tiles") / "a.tif")
    write_geotiff(cells(spark, a), path, Header(*a.shape, res_x=10, res_y=10, epsg=3035, unit="metres"), tile=64)
    return a, path


def test_blocks_are_tiles(spark, made):
    a, path = made
    tiles = read_tiles(spark, path)
    assert in_tiles(tiles) and tiles.count() == 12 and (grid(from_tiles(tiles), a.shape) == a).all()
    assert {r.v: r.n for r in st.histogram(tiles).collect()} == {r.v: r.n for r in st.histogram(cells(spark, a)).collect()}
    assert to_tiles(tiles) is tiles and read_tiles(spark, path, least=65) is None
    check_binary(tiles, special=True)
    with pytest.raises(InputError):
        check_binary(tiles)
    check_gray_cells(tiles)


def test_windows_on_tiles(spark, made):
    a, path = made
    tiles = read_tiles(spark, path)
    for f, args in ((wi.fragmentation, ("FAC", 7, 8)), (wi.fragmentation_gray, ("FED", 5, 2, 8))):
        want = grid(f(cells(spark, a), *args), a.shape)
        out = f(tiles, *args, form="tiles")
        assert in_tiles(out) and (grid(from_tiles(out), a.shape) == want).all() and (grid(f(tiles, *args, form="tile"), a.shape) == want).all()
    lm = np.clip(a, 0, 3)
    assert (grid(from_tiles(wi.mosaic(to_tiles(cells(spark, lm), 64), 5, "tiles")), a.shape) == grid(wi.mosaic(cells(spark, lm), 5), a.shape)).all()


def test_tools_in_tiles_and_in_cells(spark, made, tmp_path):
    a, path = made
    one, two = T.frag(path, "FAD", 27, outdir=str(tmp_path)), T.frag(T.Raster(cells(spark, a), T.read_geotiff(spark, path)[1], "b"), "FAD", 27, outdir=str(tmp_path), form="cell")
    assert one.raster.tiles is not None and two.raster.tiles is None and one.stats["Statistics"] == two.stats["Statistics"]
    back = [grid(read_geotiff(spark, r.files["tif"])[0], a.shape) for r in (one, two)]
    assert (back[0] == back[1]).all() and (grid(one.raster.cells, a.shape) == back[0]).all()
    wide = T.frag(path, "FAD", 131)  # a halo wider than the file's blocks
    assert (grid(wide.raster.cells, a.shape) == grid(wi.fragmentation(cells(spark, a), "FAD", 131), a.shape)).all()


def test_bytes_beyond(spark, tmp_path):
    a = np.array([[0, 70, 255], [100, 254, 30]])
    path = str(tmp_path / "gray.tif")
    write_geotiff(cells(spark, np.where(a == 255, 254, a)), path, Header(2, 3), tile=64)
    assert sorted(r.v for r in from_tiles(read_tiles(spark, path)).collect()) == [0, 30, 70, 100, 254, 254]
    strips = tmp_path / "s.tif"
    strips.write_bytes(stripped(np.ones((9, 5), np.uint8)))
    assert read_tiles(spark, str(strips)) is None
    with pytest.raises(Exception, match="not in tiles"):
        spark.read.format("geotiff").option("form", "tiles").load(str(strips)).count()


def test_segmentation_on_tiles(spark):
    rng = np.random.default_rng(6)
    a = np.ones((150, 120), int)
    for _ in range(60):
        r, c, h, w = rng.integers(0, 140), rng.integers(0, 110), *rng.integers(3, 30, 2)
        a[r : r + h, c : c + w] = 2
    a[rng.random(a.shape) < 0.01] = 1
    a[rng.random(a.shape) < 0.01] = 0
    for edge in (1, 3):
        out = mo.spa(to_tiles(cells(spark, a), 64), edge)
        assert in_tiles(out) and (grid(from_tiles(out), a.shape) == grid(mo.spa(cells(spark, a), edge, tile=64), a.shape)).all()


def test_labels_by_plain_search():
    rng = np.random.default_rng(2)
    for conn in (4, 8):
        for share in (0.1, 0.5, 0.7, 1.0):
            m = rng.random((23, 31)) < share
            label, n = label_array(m, conn)
            want, count = np.zeros(m.shape, int), 0
            for r, c in zip(*np.nonzero(m)):
                if want[r, c]:
                    continue
                count += 1
                todo = [(r, c)]
                want[r, c] = count
                while todo:
                    i, j = todo.pop()
                    for x in (-1, 0, 1):
                        for y in (-1, 0, 1):
                            p, q = i + x, j + y
                            if (conn == 8 or x * y == 0) and 0 <= p < 23 and 0 <= q < 31 and m[p, q] and not want[p, q]:
                                want[p, q] = count
                                todo.append((p, q))
            assert n == count and (label == want).all()
    assert label_array(np.zeros((3, 3), bool), 8)[1] == 0
