"""Small rasters with known results, in cell and tile form."""

import numpy as np
import pytest

from quadrille.functions.checks import InputError, check_binary, check_change_pair, check_fragmentation, check_gray, check_gray_cells, check_mspa, check_spa, check_three_class, check_thresholds, check_window
from quadrille.functions.mosaic import CODES, group_of
from quadrille.operators import change as ch
from quadrille.operators import morphology as mo
from quadrille.operators import patches as pt
from quadrille.operators import window as wi
from quadrille.operators import zonal as zo


def cells(spark, a):
    a = np.asarray(a)
    return spark.createDataFrame([(i, j, int(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row int, col int, v short")


def grid(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.row, r.col] = r.v
    return out


def full(n, v, **cells_):
    a = np.full((n, n), v)
    return a


def put(a, *at):
    a = a.copy()
    for (i, j), v in at:
        a[i, j] = v
    return a


def both(spark, f, a, *args, **more):
    """The result in cell form; the tile form, over two sizes of tiles, must be the same."""
    got = grid(f(cells(spark, a), *args, **more), a.shape)
    for tile in (4, 16):
        if tile >= args[1 if f is not wi.mosaic else 0] // 2:
            assert (grid(f(cells(spark, a), *args, form="tile", tile=tile, **more), a.shape) == got).all()
    return got


zeros, mid = np.zeros((3, 3), int), ((1, 1), 2)
K1 = put(zeros, ((0, 0), 1), ((0, 1), 1), ((0, 2), 1), ((1, 0), 1), mid)
DIAGONAL = put(full(5, 1), ((1, 1), 2), ((2, 2), 2), ((3, 3), 2))
K9 = np.zeros((5, 5), int)
K9[1:4, 1:4] = 2
K9[1, 1] = 1

FRAG = [
    (K1, "FAD", 4, False, (1, 1), 20), (K1, "FAD", 4, True, (1, 1), 11),
    (full(10, 2), "FAD", 4, False, (5, 5), 100),
    (put(full(5, 2), ((2, 2), 0)), "FAD", 4, False, (2, 2), 102), (full(5, 1), "FAD", 4, False, (2, 2), 101),
    *[(put(full(3, k), mid), m, 4, False, (0, 0), 102 + k) for k in (3, 4) for m in ("FAD", "FAC", "FED")],
    (put(zeros, mid), "FAD", 4, False, (1, 1), 100), (put(zeros, mid), "FAC", 4, False, (1, 1), 102), (put(zeros, mid), "FED", 4, False, (1, 1), 102),
    *[(full(5, 2), m, c, False, (2, 2), 100) for m in ("FAC", "FED") for c in (4, 8)],
    (put(full(5, 1), ((2, 2), 2)), "FAC", 4, False, (2, 2), 0),
    (K9, "FAC", 4, True, (2, 2), 83),
    (DIAGONAL, "FAC", 4, False, (2, 2), 0),
    (put(full(3, 1), mid, *[(p, 4) for p in ((0, 0), (0, 2), (2, 0), (2, 2))]), "FAD", 4, False, (1, 1), 20),
    (put(full(3, 1), mid, *[(p, 3) for p in ((0, 0), (0, 2), (2, 0), (2, 2))]), "FAD", 4, False, (1, 1), 11),
    (put(full(3, 2), ((0, 0), 4), ((0, 1), 4), ((0, 2), 4)), "FAC", 4, False, (1, 1), 100), (put(full(3, 2), ((0, 0), 4)), "FED", 4, False, (1, 1), 100),
]


@pytest.mark.parametrize("a,method,conn,fixed,at,want", FRAG)
def test_fragmentation(spark, a, method, conn, fixed, at, want):
    assert both(spark, wi.fragmentation, a, method, 3, conn, fixed)[at] == want


def test_relations_between_metrics(spark):
    a = put(full(5, 1), ((2, 2), 2))
    assert 0 < both(spark, wi.fragmentation, a, "FED", 3, 4)[2, 2] < 100
    assert both(spark, wi.fragmentation, DIAGONAL, "FAC", 3, 8)[2, 2] > 0
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 5, (13, 17))
    fac, fed = (both(spark, wi.fragmentation, noise, m, 5, 8) for m in ("FAC", "FED"))
    assert ((fed >= fac) | (fac > 100)).all()


GRAY = [
    (put(full(5, 30), ((2, 2), 80)), "FAD", 50, 36), (full(5, 100), "FAD", 50, 100), (full(5, 50), "FAD", 50, 50),
    (put(full(5, 80), ((2, 2), 150)), "FAD", 50, 102), (put(full(5, 80), ((2, 2), 0)), "FAD", 50, 101), (put(full(5, 80), ((2, 2), 30)), "FAD", 50, 101),
    (put(full(5, 0), ((2, 2), 80)), "FAC", 50, 0),
]


@pytest.mark.parametrize("a,method,threshold,want", GRAY)
def test_gray(spark, a, method, threshold, want):
    assert both(spark, wi.fragmentation_gray, a, method, 3, threshold)[2, 2] == want


def test_gray_whole(spark):
    a = np.zeros((15, 15), int)
    a[3:12, 3:12] = 70
    a[5:10, 5:10] = 100
    a[7, 7] = 50
    a[0, :2] = 255
    r = {m: both(spark, wi.fragmentation_gray, a, m, 3, 1) for m in ("fad", "FAC", "FED")}
    fg = r["FED"] <= 100
    assert r["FED"][fg].mean() >= r["FAC"][fg].mean() and (r["fad"][0, :2] == 102).all()
    assert (both(spark, wi.fragmentation_gray, a, "FAD", 3, 80) <= 100).sum() < fg.sum()


def test_mosaic(spark):
    assert [both(spark, wi.mosaic, full(5, k), 3)[2, 2] for k in (1, 2, 3)] == [180, 170, 190]
    assert both(spark, wi.mosaic, put(full(3, 3), mid), 3)[1, 1] == 61
    a = np.repeat([1, 2, 3], [5, 5, 1])[:, None] * np.ones((1, 11), int)
    got = both(spark, wi.mosaic, put(a, ((0, 0), 0)), 3)
    assert got[0, 0] == 0 and {180, 170} <= set(got.ravel()) <= set(CODES) | {0}
    assert len(CODES) == 103 and {group_of(c) for c in CODES} == set(range(1, 20))


def test_patches(spark):
    size = lambda a, **k: sorted(r.n for r in pt.patches(cells(spark, a), **k).sizes().collect())
    assert size([[2, 0], [0, 2]]) == [2] and size([[2, 0], [0, 2]], connectivity=4) == [1, 1]
    assert size([[2, 3, 0], [0, 0, 0]], targets=(2, 3)) == [2] and size([[2, 0, 2], [0, 0, 0]]) == [1, 1]
    rng = np.random.default_rng(3)
    noise = (rng.random((40, 40)) < 0.45) * 2
    assert size(noise, tile=8) == size(noise, tile=64)


BLOCKS = np.ones((15, 15), int)
BLOCKS[2:5, 2:5] = BLOCKS[10:14, 10:14] = 2
BLOCKS[0, 0], BLOCKS[0, 1], BLOCKS[0, 2] = 0, 3, 4


def test_accounting_and_restoration(spark):
    got = grid(pt.accounting(cells(spark, BLOCKS), [10]), BLOCKS.shape)
    assert (got[3, 3], got[11, 11], got[0, 0], got[0, 1], got[0, 2], got[7, 7]) == (103, 33, 129, 105, 176, 0)
    rows = pt.accounting_stats(cells(spark, BLOCKS), [10]).orderBy("size_class").collect()
    assert [(r.code, r.patches, r.cells) for r in rows] == [(103, 1, 9), (33, 1, 16)]
    r = pt.restoration(cells(spark, BLOCKS)).first()
    assert (r.patches, r.foreground, r.mean_size, r.median_size, r.largest) == (2, 25, 12.5, 12.5, 16)
    eca = (81 + 256) ** 0.5
    assert r.eca == round(eca) and abs(r.coh - eca / 25 * 100) < 1e-9 and r.cnoa == round(1 + 2 * 25 * eca**2 / (625 - eca**2))
    one = pt.restoration(cells(spark, put(full(3, 1), mid))).first()
    assert one.cnoa == -9999 and one.coh == 100 and one.rpot == 0


SPA = np.ones((20, 20), int)
SPA[5:15, 5:15] = 2
SPA[10, 10], SPA[2, 2], SPA[0, 0] = 1, 2, 0


def test_spa(spark):
    two, six = (grid(mo.spa(cells(spark, SPA), 1, n), SPA.shape) for n in (2, 6))
    assert (two[2, 2], two[8, 8]) == (1, 17) and (six[2, 2], six[10, 10], six[8, 8], six[0, 0]) == (9, 100, 17, 129)
    assert (six[5, 5:15] == 3).all() and six[9, 9] == 5
    assert (grid(mo.spa(cells(spark, SPA), 1, 6, tile=16), SPA.shape) == six).all()
    small = np.ones((10, 10), int)
    small[3:7, 3:7] = 2
    assert np.isin(grid(mo.spa(cells(spark, small), 1, 6), small.shape), [17, 3, 5, 9, 1]).sum() == 16


def test_mspa(spark):
    a = np.ones((20, 20), int)
    a[5:15, 5:15] = 2
    got = grid(mo.mspa(cells(spark, a), 8, 1), a.shape)
    assert (got[6:14, 6:14] == 17).all() and (got == 3).sum() == 36 and (got == 0).sum() == 300
    b = np.ones((24, 40), int)
    b[4:12, 3:11] = b[4:12, 25:33] = 2
    b[7, 11:25] = 2  # joins two cores
    b[12:18, 6] = 2  # ends nowhere
    b[14:20, 30:36] = 2
    b[17, 30:36] = 2
    b[4:12, 25:33][3:5, 3:5] = 1  # a hole
    got = grid(mo.mspa(cells(spark, b), 8, 1, intext=False), b.shape)
    assert got[7, 18] == 33 and got[15, 6] == 1
    tiled = grid(mo.mspa(cells(spark, b), 8, 1, intext=False, tile=16), b.shape)
    assert (tiled == got).all()


def test_loop(spark):
    a = np.ones((30, 30), int)
    a[5:20, 5:12] = 2
    a[7, 12:18] = a[15, 12:18] = 2
    a[7:16, 17] = 2
    got = grid(mo.mspa(cells(spark, a), 8, 1, intext=False), a.shape)
    assert got[7, 15] == 65 and got[11, 17] == 65


def test_thinning_keeps_the_line_between_anchors():
    mask, anchor = np.zeros((9, 12), bool), np.zeros((9, 12), bool)
    mask[3:6, 1:11] = True
    anchor[4, 0] = anchor[4, 11] = True
    left = mo.thin(mask, anchor)
    assert left.sum() <= 14 and left.any(axis=0)[1:11].all()
    assert not mo.thin(mask, np.zeros_like(mask)).sum() > 1


def test_change(spark):
    a, b = [101, 101, 50, 80, 102, 105, 106, 120], [101, 30, 101, 60, 10, 20, 101, 120]
    x, y = (cells(spark, [v]) for v in (a, b))
    assert grid(ch.change(x, y), (1, 8)).tolist() == [[252, 250, 251, 120, 254, 253, 253, 102]]
    tab = ch.crosstab(x, y)
    assert sum(r.n for r in tab.collect()) == 7
    got = {(r.ga, r.gb): r.n for r in ch.aggregate_matrix(tab, ch.LAND_GROUPS).collect()}
    assert got["foreground", "foreground"] == 1 and got["background", "foreground"] == 1 and got["special", "background"] == 1


def zone(spark, *points, name="z"):
    return spark.createDataFrame([(name, [[{"x": float(x), "y": float(y)} for x, y in points]])], "zone string, rings array<array<struct<x:double,y:double>>>")


def test_zones(spark):
    a = cells(spark, np.ones((100, 100), int))
    g = zo.Grid(4_000_000, 3_000_000)
    square = zone(spark, (4_000_010, 2_999_990), (4_000_040, 2_999_990), (4_000_040, 2_999_960), (4_000_010, 2_999_960))
    assert zo.zonal_histogram(a, square, g).first().n == 900
    clip = zo.extract(a, square, g, 7)
    assert clip.count() == 900 and clip.agg({"row": "min"}).first()[0] == 10
    assert zo.extract(a, zone(spark, (0, 0), (1, 0), (1, 1)), g).count() == 0
    bow = zone(spark, (4_000_000, 3_000_000), (4_000_010, 2_999_990), (4_000_010, 3_000_000), (4_000_000, 2_999_990))
    assert 30 <= zo.polygon_cells(bow, g).count() <= 70
    assert zo.nodata_of("mspa") == 129 and zo.nodata_of(None, 9) == 9 and zo.nodata_of(None) == 0


@pytest.mark.parametrize("w", [4, 2, 1, 3.0, "3", None, True, -3])
def test_windows_refused(w):
    with pytest.raises(InputError):
        check_window(w)


def test_arguments():
    for bad in (("fad", 3, 4), ("FOS", 3, 4), ("", 3, 4), ("FAC", 3, 6)):
        with pytest.raises(InputError):
            check_fragmentation(*bad)
    check_fragmentation("FAD", 3, 99)
    assert check_gray("fac", 3, 1, 8) == "FAC"
    for t in (0, 101, 1.5, None):
        with pytest.raises(InputError):
            check_gray("FAD", 3, t, 4)
    assert check_thresholds([100, 10, 10, "5"]) == [5, 10, 100]
    for bad in ([], [1, 2, 3, 4, 5, 6], [0], [-1], ["x"], "10", 5, None):
        with pytest.raises(InputError):
            check_thresholds(bad)
    for bad in ((0, 6), (1.0, 6), (1, 4)):
        with pytest.raises(InputError):
            check_spa(*bad)
    for bad in ((6, 1), (8, 0)):
        with pytest.raises(InputError):
            check_mspa(*bad)


def test_domains(spark):
    c = lambda *v: cells(spark, [list(v)])
    check_binary(c(1, 2, 0))
    check_binary(c(1, 2, 3, 4), special=True)
    check_three_class(c(1, 2, 3, 0))
    check_gray_cells(c(0, 1, 255))
    for f, x in ((check_binary, c(1, 1)), (check_binary, c(2)), (check_binary, c(1, 2, 3)), (check_three_class, c(1, 2)), (check_three_class, c(1, 2, 3, 4)), (check_gray_cells, c(0, 101)), (check_gray_cells, c(-1, 5))):
        with pytest.raises(InputError):
            f(x)
    with pytest.raises(InputError):
        check_binary(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, v double"))
    with pytest.raises(InputError):
        check_change_pair({"tool": "frag", "window": 3}, {"tool": "frag", "window": 5})
    with pytest.raises(InputError):
        check_change_pair({"tool": "acc"}, {"tool": "frag"})
