from collections import Counter

import pytest
from test_sharding import law_holds

from quadrille.llm.sharding import balanced_shards, place_whole


def cut_groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = balanced_shards(docs).collect()
    assert len(got) == len(texts)
    law_holds(got, 24)
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    return {t for t, s in where.items() if len(s) > 1}


@pytest.mark.parametrize("copies, groups, own", [(2, 1164, 72), (20, 475, 500), (2, 240, 0)])
def test_copies_that_are_most_rows_stay_together(spark, copies, groups, own):
    texts = [f"group {i % groups}" for i in range(copies * groups)] + [f"own {i}" for i in range(own)]
    assert not cut_groups(spark, texts)


def test_a_hot_text_and_pairs(spark):
    texts = ["hot"] * 800 + [f"pair {i % 740}" for i in range(1480)] + [f"own {i}" for i in range(120)]
    assert cut_groups(spark, texts) == {"hot"}


def test_what_cannot_stay_whole_is_counted():
    assert place_whole({2: 36}, [3] * 24)[1] == 12
    plan, left = place_whole({3: 2, 2: 3}, [6, 6])
    used = Counter()
    for c, a, b, s in plan:
        used[s] += c * (b - a)
    assert left == 0 and max(used.values()) <= 6
