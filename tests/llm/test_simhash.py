import random
import re

import numpy as np
import xxhash
from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.simhash import fingerprints, hamming_links, keep_one, masks, near_duplicates, simhash, tile_links


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(prints, radius=2):
    """(id, print) pairs to the smallest id reachable; None never counts as smallest."""
    todo, out = set(range(len(prints))), {}
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            i = edge.pop()
            group.add(i)
            near = {j for j in todo if (prints[i][1] ^ prints[j][1]).bit_count() <= radius}
            todo -= near
            edge += near
        least = min((prints[i][0] for i in group if prints[i][0] is not None), default=None)
        out |= dict.fromkeys(group, least)
    return [out[i] for i in range(len(prints))]


def test_query_by_brute_force(spark, sf):
    docs = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, f"{p:016x}", c) for (i, p), c in zip(docs, brute_groups(docs))}
    assert {tuple(r) for r in Q.op5_simhash(spark, sf).collect()} == want


def links_by_brute_force(spark, radius, hot, seed, size):
    rng = random.Random(seed)
    prints = []
    for _ in range(size):
        x = rng.getrandbits(64) if not prints or rng.random() < 0.3 else rng.choice(prints)
        for _ in range(rng.randint(0, 2 * radius)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    at = {x: i for i, x in enumerate(prints)}
    label = list(range(len(prints)))
    pairs = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in hamming_links(df, radius, hot).collect()]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = brute_groups(list(enumerate(prints)), radius)
    assert label == want and len(set(want)) < len(prints)


def test_links_by_brute_force(spark):
    links_by_brute_force(spark, 2, 16384, 1, 400)
    links_by_brute_force(spark, 2, 4, 2, 400)  # every bucket of five or more is dealt by bit count
    links_by_brute_force(spark, 6, 16384, 3, 300)
    links_by_brute_force(spark, 6, 4, 4, 300)


def test_masks_keep_close_pairs_together():
    rng = random.Random(8)
    for n in (10, 10**5, 10**8, 10**11):
        for radius in (2, 4, 6):
            m = masks(n, radius)
            for _ in range(200):
                a = rng.getrandbits(64)
                b = a
                for _ in range(radius):
                    b ^= 1 << rng.randrange(64)
                assert any(a & x == b & x for x in m)
    assert len(masks(1000, 2)) == 3 and len(masks(10**8, 6)) > len(masks(1000, 6))


def test_tiles_skip_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    x = np.unique(np.concatenate((x, x ^ np.uint64(1), x ^ np.uint64(6))))
    a, b = tile_links(x, 2, tile=64)
    near = {frozenset((int(p), int(q))) for p in x for q in x[np.bitwise_count(x ^ p) <= 2] if p != q}
    label = {int(v): int(v) for v in x}
    for _ in range(8):
        for p, q in zip(a.tolist(), b.tolist()):
            label[p] = label[q] = min(label[p], label[q])
    assert all(len({label[v] for v in s}) == 1 for s in near)


def test_awkward_documents(spark):
    docs = [(r[0], simhash(r[1])) for r in rows()]
    want = sorted(((i, p, c) for (i, p), c in zip(docs, brute_groups(docs))), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(awkward(spark)).collect()), key=repr)
    assert got == want
    assert near_duplicates(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0
    assert all(simhash(r[1]) == brute_print(r[1]) for r in rows() if r[1] is None or len(r[1]) < 10_000)


def test_one_of_each_group_stays(spark):
    stay = keep_one(awkward(spark))
    assert stay.columns == awkward(spark).columns
    ids = sorted(r.doc_id for r in stay.collect() if r.doc_id is not None)
    assert 6 not in ids and 10 not in ids and 1 not in ids and {0, 3, 4, 9, 11} <= set(ids)
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "e f g h")], "doc_id long, text string")
    assert keep_one(nulls).count() == 3
    assert fingerprints(nulls).count() == 3
