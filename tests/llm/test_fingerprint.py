import hashlib
import random

import numpy as np
from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.fingerprint import BINS, _probe, edited_neighbours, fingerprint, likeness, shingle_hashes, with_fingerprints


def brute_print(raw):
    h = shingle_hashes(raw).tolist()
    if not h:
        return b""
    bins = [min((x for x in h if x >> 56 == b), default=None) for b in range(BINS)]
    low = []
    for b in range(BINS):
        s = b if bins[b] is not None else next((int(p) for p in _probe[:, b] if bins[p] is not None), None)
        s = next(i for i in range(BINS) if bins[i] is not None) if s is None else s
        low.append(bins[s] & 15)
    return bytes(a << 4 | b for a, b in zip(low[::2], low[1::2]))


def brute(docs):
    out = []
    for k, (i, t) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        p, e, x = (fingerprint(s.encode()) for s in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p.hex(), e.hex(), likeness(p, e), likeness(p, x)))
    return out


def test_query_by_brute_force(spark, sf):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = [tuple(r) for r in Q.op2_fingerprints(spark, sf).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    assert sorted(got) == sorted(brute(docs))


def test_densification_by_brute_force():
    rng = random.Random(3)
    for n in (1, 4, 5, 7, 40, 300, 3000):
        raw = " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n)).encode()
        assert fingerprint(raw) == brute_print(raw)


def test_likeness_is_near_jaccard():
    rng, errors = random.Random(1), []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        k = int(share * len(a))
        b = a[:k] + [f"v{rng.randrange(10**6)}" for _ in range(len(a) - k)]
        x, y = (set(shingle_hashes(" ".join(t).encode()).tolist()) for t in (a, b))
        errors.append(likeness(*(fingerprint(" ".join(t).encode()) for t in (a, b))) - len(x & y) / len(x | y))
    assert np.abs(errors).max() < 0.12


def test_awkward_documents(spark):
    got = edited_neighbours(awkward(spark)).collect()
    assert len(got) == len(rows())
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    prints = {(r.doc_id): r.fingerprint for r in got if r.doc_id is not None}
    assert prints[5] == prints[6] and prints[9] == prints[10] and not prints[0] and not prints[1] and not prints[2]
    assert edited_neighbours(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    r = edited_neighbours(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"a b a b").digest()[:0] + hashlib.sha256(("a b c d"[:4] + "a b").encode()).digest()
    assert with_fingerprints(awkward(spark)).count() == len(rows())


def test_long_texts_come_in_pieces():
    words = [f"w{i % 5000}" for i in range(400_000)]
    raw = " ".join(words).encode()
    assert set(shingle_hashes(raw).tolist()) == set(shingle_hashes(" ".join(words[:10_004]).encode()).tolist())
