"""Connected components of a link table by iterated Spark joins, or in one task where it is small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut

__all__ = ["connected_components"]

#: Links that one task solves: 16 bytes each.
SMALL = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach.

    Up to ``small`` links, which are counted first, go to one task. More are solved by alternating
    large-star and small-star rounds (Kiveris et al. 2014): the number of edges never grows by
    more than the number of nodes, and long chains shrink geometrically. Each round is written
    to the shared folder. Returns ``(node, root)``, one row per node that has an edge; self-loops
    and repeated edges are harmless, null ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b").selectExpr("least(a, b) u", "greatest(a, b) v").distinct()
    e = cut(e, "edges")
    if e.count() <= small:
        return e.coalesce(1).mapInArrow(_solve, "node long, root long")
    before = None
    for _ in range(max_rounds):
        # large star: each node links its larger neighbours to the least of its neighbourhood
        both = e.selectExpr("v x", "u y").union(e.selectExpr("u x", "v y"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").selectExpr("m u", "y v").where("u <> v").distinct()
        # small star: each node links its smaller neighbours, and itself, to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        settled = large.join(low, "v").selectExpr("m u", "u v").where("u <> v").union(low.selectExpr("m u", "v")).distinct()
        e = cut(settled, "edges")
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before or n == 0:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.selectExpr("v node", "u root")
    return stars.union(e.selectExpr("u node", "u root").distinct())


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hooking to the smaller root and pointer jumping until nothing changes."""
    pairs = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches]
    if not pairs:
        return
    nodes, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])
