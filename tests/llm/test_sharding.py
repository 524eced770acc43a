import zlib
from collections import Counter

from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.sharding import balanced_shards


def law_holds(got, shards):
    n = Counter(r.shard for r in got)
    sizes = [n[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(n) <= set(range(shards))
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op7_sharding(spark, sf).collect()
    law_holds(got, 24)
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(b) + 8, zlib.crc32(b)) for i, b in docs.items()}
    # copies stay together where a shard can take them
    where = {}
    for r in got:
        where.setdefault(docs[r.doc_id], set()).add(r.shard)
    count = Counter(docs.values())
    linked = [b for b in count if 1 < count[b] <= 2]
    assert sum(len(where[b]) == 1 for b in linked) >= 0.9 * len(linked)


def test_a_group_that_no_shard_can_take(spark):
    docs = spark.createDataFrame([(i, "same" if i < 300 else f"own {i}" if i < 400 else f"pair {i // 2}") for i in range(1000)], "doc_id long, text string")
    got = balanced_shards(docs).collect()
    law_holds(got, 24)
    pairs = {}
    for r in got:
        if r.doc_id >= 400:
            pairs.setdefault(r.doc_id // 2, set()).add(r.shard)
    assert sum(len(v) == 1 for v in pairs.values()) > 0.9 * len(pairs)


def test_awkward_documents(spark):
    got = balanced_shards(awkward(spark)).collect()
    law_holds(got, 24)
    assert len(got) == len(rows())
    law_holds(balanced_shards(awkward(spark), shards=3).collect(), 3)
    assert balanced_shards(empty(spark)).count() == 0
