"""Connectors of MSPA against plain loops over sets of cells, and on maps made by hand."""

import numpy as np
import pytest
from test_kernels import cells, grid

from quadrille.operators import morphology as mo

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def parts(cells_, steps):
    left, out = set(cells_), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for i, j in steps:
                if (r + i, c + j) in left:
                    left.remove((r + i, c + j))
                    part.add((r + i, c + j))
                    todo.append((r + i, c + j))
        out.append(part)
    return out


def beside(p, there):
    return {(p[0] + i, p[1] + j) for i, j in EIGHT} & there


def simple(p, there, conn):
    """Nothing is joined or parted where p goes: one part of the foreground round it, one of the background."""
    fg = beside(p, there)
    bg = {(p[0] + i, p[1] + j) for i, j in EIGHT} - fg
    own, other = (EIGHT, FOUR) if conn == 8 else (FOUR, EIGHT)
    edge = {(p[0] + i, p[1] + j) for i, j in FOUR}
    touch = lambda ps, steps: [x for x in ps if steps is EIGHT or x & edge]
    return len(touch(parts(fg, own), own)) == 1 and len(touch(parts(bg, other), other)) == 1


def thinned(mask, core, conn):
    there, tried = mask | core, set(mask)
    while True:
        ok = {p for p in there - core if simple(p, there, conn)}
        gone = set()
        for p in tried & ok:
            goes = beside(p, there) & ok
            if any(not simple(p, there - {q}, conn) for q in goes):
                if conn == 8:
                    continue
                held = [q for q in goes if not simple(p, there - {q}, conn)]
                across = [q for q in held if abs(q[0] - p[0]) == abs(q[1] - p[1]) == 1]
                edges = {(p[0] + i, p[1] + j) for i, j in FOUR} & there
                if len(held) != 1 or len(across) != 1 or len(edges) != 2 or not {(p[0], across[0][1]), (across[0][0], p[1])} <= goes:
                    continue
                if all(len({(q[0] + i, q[1] + j) for i, j in FOUR} & there) == 2 for q in goes & edges):
                    continue
            elif len(goes) in (2, 3) and all(len(beside(q, there)) == len(goes) == len(beside(q, there) & beside(p, there)) + 1 for q in goes):
                continue
            gone.add(p)
        if not gone:
            return there - core
        there -= gone
        tried = {q for p in gone for q in beside(p, there)} - core


def brute(a, conn, edge):
    """Codes of a map without missing cells: cores, islets, connectors; rims by their distance."""
    h, w = a.shape
    pad = 3 * (edge + 2)
    big = np.pad(a, pad, mode="edge")
    fg = {(r - pad, c - pad) for r, c in zip(*np.nonzero(big == 2))}
    bg = {(r - pad, c - pad) for r, c in zip(*np.nonzero(big != 2))}
    far = (edge + 0.98) ** 2
    inside = [(i, j) for i in range(-edge - 1, edge + 2) for j in range(-edge - 1, edge + 2) if i * i + j * j <= far]
    core = {p for p in fg if not any((p[0] + i, p[1] + j) in bg for i, j in inside)}
    steps = EIGHT if conn == 8 else FOUR
    joined = {p for part in parts(fg, steps) if part & core for p in part}
    mask = joined - core
    line = thinned(mask, core, conn)
    near = set(line)
    if edge == 2:  # within 1.57: beside it, or across by way of a cell of the mask
        one = {(r + i, c + j) for r, c in line for i, j in FOUR} & mask
        two = {(r + i, c + j) for r, c in line for i, j in EIGHT} & mask
        near |= one
        for _ in range(4):
            near |= {p for p in two if any((p[0] + i, p[1] + j) in near for i, j in FOUR)}
    cores = parts(core, steps)
    kind = {}
    for part in parts(near, steps):
        met = [k for k, x in enumerate(cores) if any((r + i, c + j) in x for r, c in part for i, j in steps)]
        kind |= dict.fromkeys(part, 32 if len(met) > 1 else 64)
    return core, fg - joined, {p: k for p, k in kind.items() if 0 <= p[0] < h and 0 <= p[1] < w}


@pytest.mark.parametrize("conn, edge, tile", [(8, 1, 64), (8, 2, 64), (4, 1, 64), (8, 1, 20), (4, 2, 64)])
def test_connectors_by_plain_loops(spark, conn, edge, tile):
    rng = np.random.default_rng(10 * conn + edge)
    a = np.ones((34, 46), int)
    for _ in range(16):
        r, c, h, w = rng.integers(0, 30), rng.integers(0, 40), *rng.integers(4, 10, 2)
        a[r : r + h, c : c + w] = 2
    for _ in range(14):
        r, c, n = rng.integers(0, 34), rng.integers(0, 36), rng.integers(4, 14)
        (a[r, c : c + n] if rng.random() < 0.6 else a[r : r + n, c])[:] = 2
    a[rng.random(a.shape) < 0.04] = 1
    a[rng.random(a.shape) < 0.02] = 2
    got = grid(mo.mspa(cells(spark, a), conn, edge, intext=False, tile=tile), a.shape)
    core, islet, kind = brute(a, conn, edge)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            v = int(got[r, c])
            assert (v == 17) == ((r, c) in core) and (v == 9) == ((r, c) in islet)
            assert v & 96 == kind.get((r, c), 0), (r, c, v)
    assert set(kind.values()) == {32, 64} and set(np.unique(got)) & {35, 37} and set(np.unique(got)) & {67, 69}


def test_bridges_and_loops_run_through_rims(spark):
    a = np.ones((24, 40), int)
    a[4:12, 3:11] = a[4:12, 25:33] = 2
    a[7, 11:25] = 2  # joins two cores
    a[15, 3:8] = a[12:15, 3] = a[12:15, 7] = 2  # back to the same core
    got = grid(mo.mspa(cells(spark, a), 8, 1, intext=False), a.shape)
    assert (got[7, 11:25] == 33).all() and got[7, 10] == got[7, 25] == 35
    assert got[15, 5] == 65 and 67 in got[11, 3:8] and (got[5:11, 4:10] == 17).all()
    assert got[4, 3] == 3


def test_long_and_large_regions_go_on_in_tiles(spark):
    """A dead end of many cells over tiles is peeled wholly, in tasks as well as in tiles."""
    a = np.ones((26, 120), int)
    a[3:11, 3:11] = a[3:11, 100:110] = 2
    a[6, 11:100] = 2  # a bridge
    a[7:24, 50] = 2  # a dead end
    a[23, 20:90] = 2
    one = grid(mo.mspa(cells(spark, a), 8, 1, intext=False, tile=20), a.shape)
    assert (one[6, 11:49] == 33).all() and (one[6, 52:100] == 33).all() and (one[10:24, 50] == 1).all() and (one[23, 20:90] == 1).all()
    limit, mo.LIMIT = mo.LIMIT, 10
    default, mo.connectors.__defaults__ = mo.connectors.__defaults__, (20, 10)
    try:
        assert (grid(mo.mspa(cells(spark, a), 8, 1, intext=False, tile=20), a.shape) == one).all()
    finally:
        mo.LIMIT, mo.connectors.__defaults__ = limit, default


def test_openings_beside_missing_cells(spark):
    a = np.ones((11, 11), int)
    a[3:8, 3:8] = 2
    a[4:7, 4:7] = 1
    whole = grid(mo.mspa(cells(spark, a), 8, 1), a.shape)
    assert (whole[4:7, 4:7] == 220).all()
    a[3, 5] = 0  # a missing cell in the ring is closed by those beside it
    got = grid(mo.mspa(cells(spark, a), 8, 1), a.shape)
    assert (got[4:7, 4:7] == 220).all() and got[3, 5] == 129
    b = np.ones((8, 12), int)
    b[0, 4] = b[0, 6] = b[1, 4:7] = 2  # a bay of one cell at the border of the map counts as closed there
    assert grid(mo.mspa(cells(spark, b), 8, 1), b.shape)[0, 5] == 220
