import corpus_pipeline as C
import pytest
from cases import awkward, empty
from test_packing import brute_pieces, packed_well
from test_simhash import brute_groups, brute_print
from test_suffix import brute

from quadrille.llm.langid import keep_identified


def kept_of(spark, docs, name):
    return dict(C.STAGES)[name](spark, docs, "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def test_language_keeps_clean_documents(spark, docs):
    kept = kept_of(spark, docs, "language")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.where("text rlike '[a-z]'").count()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in keep_identified(docs).collect()}


def test_near_copies_by_brute_force(spark, docs):
    rows = [(r.doc_id, brute_print(r.text, 5)) for r in docs.collect()]
    want = {i for (i, _), c in zip(rows, brute_groups(rows, 6)) if i == c}
    got = kept_of(spark, docs, "near_copies")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_repeated_passages_by_brute_force(spark, docs):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = {}
    for (i, b), gone in zip(rows, brute(rows, 200, True)):
        t = b.decode()
        at, kept = 0, []
        for c in t:  # a character goes if all its bytes do
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        if kept or not any(gone):
            want[i] = "".join(kept)
    got = {r.doc_id: r for r in kept_of(spark, docs, "repeated_passages").collect()}
    assert {i: r.text or "" for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_run(spark, sf, docs):
    got = C.run(spark, sf).collect()
    rest = docs
    for _, f in C.STAGES[:-1]:
        rest = f(spark, rest, sf)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces([(r.doc_id, r.text) for r in rest.collect()])
    packed_well(got)


def test_awkward_and_empty_tables(spark):
    rest, none = awkward(spark), empty(spark)
    for k, (_, f) in enumerate(C.STAGES):
        out, nothing = f(spark, rest, ""), f(spark, none, "")
        assert nothing.count() == 0
        if k < len(C.STAGES) - 1:
            assert out.columns == rest.columns and out.schema["text"].dataType == rest.schema["text"].dataType
            rest = out
    packed_well(out.collect())
