"""Every registered raster query against its SQL, and the two forms against each other."""

import compare
import numpy as np
import pytest
from test_kernels import cells, grid

from quadrille.operators import morphology as mo
from quadrille.plans import queries as core

SQL = core.oracle_sql()
NO_SQL = {"mspa", "mspa_stats"}


@pytest.fixture(scope="module")
def db(sf):
    return compare.connect(sf)


def test_all_have_sql():
    assert set(core.queries()) - set(SQL) == NO_SQL


@pytest.mark.parametrize("name", [n for n in core.queries() if n in SQL])
def test_query(spark, sf, db, name):
    assert compare.differences(core.queries()[name](spark, sf), db, SQL[name]) is None


def plain(v):
    """A code without the marks of openings and connectors."""
    return v if v in (129, 220) else (v - 100 if v >= 100 else v) & ~96


def test_morphology_agrees_with_its_simplified_form(spark, sf):
    """Core, edge, perforation and islet are the same in both wherever the map's border is no part of
    it: SPA takes what lies outside the map for background, MSPA goes on with the outermost cells."""
    for edge in (1, 2):
        rng = np.random.default_rng(edge)
        a = np.ones((60, 80), int)
        for _ in range(30):
            r, c, h, w = rng.integers(6, 44), rng.integers(6, 62), *rng.integers(3, 12, 2)
            a[r : r + h, c : c + w] = 2
        a[rng.random(a.shape) < 0.02] = 1
        missing = rng.random(a.shape) < 0.01
        a[:6] = a[-6:] = 1
        a[:, :6] = a[:, -6:] = 1
        a[missing] = 0
        x, y = grid(mo.spa(cells(spark, a), edge, 6), a.shape), grid(mo.mspa(cells(spark, a), 8, edge), a.shape)
        y = np.vectorize(plain)(y)
        for code in (17, 3, 5, 9, 129):
            assert ((x == code) == (y == code)).all(), code
        assert (np.isin(y[x == 1], 1)).all() and np.isin(y[(x == 0) | (x == 100)], (0, 220)).all()
    a = {(r.row, r.col): r.v for r in core.queries()["spa_6"](spark, sf).collect()}
    b = {(r.row, r.col): plain(r.v) for r in core.queries()["mspa"](spark, sf).collect()}
    assert set(a) == set(b)
    other = {k for k in a if a[k] in (17, 3, 5, 9, 129) and a[k] != b[k]}
    assert len(other) == 7 and all((a[k], b[k]) == (3, 5) and k[0] <= 2 for k in other)  # a bay at the upper border


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["row", "col", "v"] and df.count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())
