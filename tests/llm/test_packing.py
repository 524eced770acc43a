import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from cases import awkward, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrille.llm import queries as Q
from quadrille.llm.packing import TextTokens, best_fit, pack, pack_lengths, sum_of_squares, token_pieces

PATH = Q.vocabulary("word_bpe_49k.json")
T, WORDS = Tokenizer.from_file(PATH), TextTokens(PATH)


def brute_pieces(docs, capacity=4096):
    out = []
    for i, t in docs:
        ids = [*T.encode(t or "", add_special_tokens=False).ids, 1]
        out += [(i, k, a, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, a in enumerate(range(0, len(ids), capacity)) for p in [ids[a : a + capacity]]]
    return sorted(out, key=repr)


def packed_well(got, capacity=4096):
    where = {}
    for r in got:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in where.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(where)


def test_query_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.op10_packing(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces(docs)
    assert packed_well(got) <= -(-sum(r.length for r in got) // 4096) + 1


def naive(sizes, capacity):
    """Sum-of-squares packing by trying every gap."""
    gaps, out, bins = [], [], 0
    for s in sizes:
        def total(change):
            n = {}
            for g in change:
                if g:
                    n[g] = n.get(g, 0) + 1
            return sum(v * v for v in n.values())

        options = [(total([*gaps, capacity - s]), capacity, None)]
        for g in sorted({g for g in gaps if g >= s}):
            i = max(k for k, x in enumerate(gaps) if x == g)
            options.append((total([*gaps[:i], g - s, *gaps[i + 1 :]]), g, i))
        best = min(options, key=lambda o: (o[0], o[1]))
        if best[2] is None:
            gaps.append(capacity - s)
            out.append((bins, capacity - s))
            bins += 1
        else:
            gaps[best[2]] -= s
            out.append((None, gaps[best[2]]))
    return [g for _, g in out], bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_rule_by_trying_every_gap(sizes):
    got = sum_of_squares(np.array(sizes, np.int64), 12).tolist()
    left, after = {}, []
    for s, b in zip(sizes, got):
        left[b] = left.get(b, 12) - s
        after.append(left[b])
    assert (after, len(left)) == naive(sizes, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_every_packing_fits(sizes):
    x = np.array(sizes, np.int64)
    for f in (sum_of_squares, best_fit, pack_lengths):
        b = f(x, 30)
        assert np.bincount(b, x).max() <= 30 and set(b.tolist()) == set(range(b.max() + 1))


piece = st.one_of(st.sampled_from(["the", "Don't", "İ", "ß", "é", "...", "?!", "</w>", "<|endoftext|>", "<|end", "漢字", " ", "　", "\n", "a.b", "x,", "1st", "²"]), st.text(max_size=5))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(piece, max_size=8).map(" ".join), min_size=1, max_size=4))
def test_words_give_the_text_s_ids(texts):
    got = [x.tolist() for x in WORDS.encode(pa.array(texts, pa.string()))]
    assert got == [T.encode(t, add_special_tokens=False).ids for t in texts]


def test_awkward_documents(spark):
    got = pack(awkward(spark), PATH).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces([r[:2] for r in rows()])
    packed_well(got)
    assert pack(empty(spark), PATH).count() == 0
    many = pack(awkward(spark), PATH, group_tokens=1 << 14, with_ids=True).collect()
    packed_well(many)
    assert all(len(r.ids) == r.length for r in many)


def test_long_texts_come_in_parts():
    rng = random.Random(1)
    t = " ".join(rng.choice(["alpha", "beta,", "gamma", "d'accord"]) for _ in range(900_000))
    assert len(t) > TextTokens.PART
    a, b = next(WORDS.encode(pa.array([t]))), T.encode(t, add_special_tokens=False).ids
    assert a.tolist() == b


def test_other_tokenizers_encode_whole_texts(spark):
    path = Q.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in token_pieces(spark.createDataFrame([(1, "Two  Words"), (2, None)], "doc_id long, text string"), path, with_ids=True).collect()}
    assert got == {1: [*t.encode("Two  Words", add_special_tokens=False).ids, 1], 2: [1]}
