import hashlib
import random

import numpy as np
from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.suffix import deduplicate, hashed_order, longest_previous_factor, remove_repeats, suffix_order


def brute(docs, length, first=False):
    """Of (doc_id, bytes) in order: what is removed from each, as a list of flags."""
    seen = {}
    for d, (_, b) in enumerate(docs):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((d, p))
    out = [[False] * len(b) for _, b in docs]
    for v in seen.values():
        for d, p in (v[1:] if first else v) if len(v) > 1 else ():
            out[d][p : p + length] = [True] * length
    return out


def facts(b, gone):
    spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
    return len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def check(spark, docs, length, **more):
    df = spark.createDataFrame([(i, b.decode("latin-1")) for i, b in docs], "doc_id long, text string").repartition(4)
    docs = [(i, b.decode("latin-1").encode()) for i, b in docs]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in deduplicate(df, length=length, **more).collect()}
    first = more.get("keep_first", False)
    assert got == {i: facts(b, g) for (i, b), g in zip(docs, brute(sorted(docs), length, first))}


def corpus(rng, n):
    """Texts that share passages, repeat themselves and hold runs of one byte."""
    pool = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(10, 90))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.4 else bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.2:
            parts.append(b"z" * rng.randint(10, 120))
        out.append((i, b"".join(parts)))
    return out


def test_small_corpora_by_brute_force(spark):
    rng = random.Random(5)
    for k in range(4):
        check(spark, corpus(rng, 40), (20, 24, 33, 48)[k], keep_first=bool(k % 2))


def test_hot_groups_by_brute_force(spark):
    rng = random.Random(6)
    passage = bytes(rng.randrange(97, 123) for _ in range(70))
    docs = [(i, bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 30))) + passage[rng.randint(0, 20) : rng.randint(50, 70)] + bytes(rng.randrange(97, 123) for _ in range(20))) for i in range(60)]
    for hot in (0, 3, 20_000):
        check(spark, docs, 24, hot=hot)
        check(spark, docs, 24, hot=hot, keep_first=True)


def test_query_by_brute_force(spark, sf):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {i: facts(b, g) for (i, b), g in zip(docs, brute(docs, 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op4_suffix_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_awkward_documents(spark):
    got = deduplicate(awkward(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_bytes == 0 and by[0].text is None and by[0].kept == b""
    assert by[9].n_removed == by[9].n_bytes == by[10].n_removed
    assert by[11].n_removed == 5000 and by[11].n_spans == 1
    assert by[8].n_removed > 0 and {"k", "th", "ranges", "fp"} <= set(by[8].asDict())
    first = {r.doc_id: r for r in deduplicate(awkward(spark), keep_first=True, chars=True).collect() if r.doc_id is not None}
    assert first[10].kept == b"" and first[11].n_removed == 4999  # all but the place before the first later copy
    assert all(bytes(r.kept).decode() is not None for r in first.values())
    assert deduplicate(empty(spark)).count() == 0


def test_longest_previous_factor():
    rng = random.Random(2)
    for _ in range(80):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24)))
        n = len(t)
        want = [max([0, *(next((m for m in range(n - i, 0, -1) if t[i : i + m] == t[j : j + m]), 0) for j in range(i))]) for i in range(n)]
        assert longest_previous_factor(t) == want


def test_removal_follows_longest_previous_factors(spark):
    rng = random.Random(9)
    for _, b in corpus(rng, 6):
        b = b * 2
        far = longest_previous_factor(b)
        gone = [any(far[q] >= 20 for q in range(max(0, p - 19), p + 1)) for p in range(len(b))]
        assert gone == brute([(0, b)], 20, True)[0]


def test_suffix_order():
    rng = random.Random(4)
    buf = np.array([rng.choice(b"ab") for _ in range(300)], np.uint8)
    order, rank = suffix_order(buf, np.arange(280), 20)
    t = buf.tobytes()
    assert order.tolist() == sorted(range(280), key=lambda i: (t[i : i + 20], i))
    assert all((rank[i] == rank[j]) == (t[i : i + 20] == t[j : j + 20]) for i in range(0, 280, 7) for j in range(280))


def test_large_groups_by_hashes():
    rng = random.Random(7)
    buf = np.array([rng.choice(b"ab") for _ in range(3000)], np.uint8)
    starts = np.array([i for i in range(2980) if i % 50 < 31])
    a, b = suffix_order(buf, starts, 12), hashed_order(buf, starts, 12)
    groups = lambda x: sorted(tuple(np.flatnonzero(x[1] == r)) for r in np.unique(x[1]))
    assert groups(a) == groups(b)
    assert all(b[0][k] < b[0][k + 1] for k in range(len(starts) - 1) if b[1][b[0][k]] == b[1][b[0][k + 1]])


def test_whole_characters():
    raw = "é".encode() * 10
    kept, spans = remove_repeats(raw, [{"pos": 3, "n": 1}], length=6, chars=True)
    assert spans == [(4, 8)] and kept.decode() == "é" * 8
