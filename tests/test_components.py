import random

import pytest

from quadrille.operators.components import connected_components


@pytest.mark.parametrize("small", [0, 10**6])
def test_by_plain_search(spark, small):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (None, 3)]
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), small=small).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0
