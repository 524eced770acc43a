import random
import re

import corpus_pipeline as C
import numpy as np
import pytest
from cases import awkward, empty

from quadrille.llm.simhash import similar_groups, similar_links


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b, least=0.8):
    return len(a & b) >= least * len(a | b) - 1e-9


def brute(docs):
    """Smallest id reachable, by the shingle sets themselves."""
    sets, label = [shingles(t) for _, t in docs], [i for i, _ in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if similar(sets[i], sets[j])]
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return {i: c for (i, _), c in zip(docs, label)}


@pytest.fixture(scope="module")
def edited():
    """Texts of 9 to 400 words and copies with some words changed, on both sides of 0.8."""
    rng, texts = random.Random(5), []
    for _ in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 12, 30, 100, 400]))]
        texts.append(" ".join(words))
        for _ in range(2):
            again = list(words)
            for _ in range(max(1, len(words) * rng.randint(1, 5) // 100)):
                again[rng.randrange(len(again))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(again[: len(again) - rng.randrange(3)]))
    return list(enumerate(texts))


def test_all_copies_of_0_8_go_and_no_others(spark, edited):
    want = brute(edited)
    df = spark.createDataFrame(edited, "doc_id long, text string")
    assert dict(map(tuple, similar_groups(df).collect())) == want
    assert 150 < len(set(want.values())) < 450
    assert dict(map(tuple, similar_groups(df, tile=40, chunk=2).collect())) == want  # many tiles and chunks
    assert {r.doc_id for r in C.near_copies(spark, df, "").collect()} == set(want.values())


def test_stage_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert {r.doc_id for r in C.near_copies(spark, df, "").collect()} == set(want.values())


def test_links_are_counted_out():
    a = np.arange(100, dtype=np.uint64)
    assert similar_links([a, a[:80], a[:79]], 0.8) in ([(2, 1), (1, 0)], [(2, 1), (0, 1)])
    assert similar_links([a, a[:79]], 0.8) == [] and similar_links([a[:4], a[:5]], 0.8) == [(0, 1)]


def test_awkward_documents(spark):
    assert similar_groups(awkward(spark)).count() == awkward(spark).count() and similar_groups(empty(spark)).count() == 0
