import itertools
import zlib

import numpy as np
from cases import awkward, empty, rows

from quadrille.llm import queries as Q
from quadrille.llm.langid import CHAIN, Words, fit, forward_backward, identify, keep_identified, label, sample, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op6_language(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert len(held) > 200 and right / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text number {i} here", "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "zz") for i in range(80)], "doc_id long, text string, lang string")
    assert set(sample(docs)[1]) == {"aa"} and train(docs).langs == ["aa"]


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    length = np.array([4, 2])
    gamma, pairs, z = forward_backward(score, move, length)
    total = np.zeros((3, 3))
    for c in range(2):
        n = length[c]
        weight = {y: np.exp(sum(score[c, t, y[t]] for t in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product(range(3), repeat=n)}
        whole = sum(weight.values())
        assert abs(np.log(whole) - z[c]) < 1e-9
        for t in range(n):
            for k in range(3):
                assert abs(sum(w for y, w in weight.items() if y[t] == k) / whole - gamma[c, t, k]) < 1e-9
        for y, w in weight.items():
            for a, b in itertools.pairwise(y):
                total[a, b] += w / whole
    assert np.abs(total - pairs).max() < 1e-9


def test_words_of_switched_text_get_their_own_language():
    en = "the house and the garden with some other people walking there"
    fr = "la maison et le jardin avec quelques autres gens qui marchent"
    m = fit([" ".join(en.split()[i:] + en.split()[:i]) for i in range(11)] * 3 + [" ".join(fr.split()[i:] + fr.split()[:i]) for i in range(11)] * 3, ["en"] * 33 + ["fr"] * 33)
    gamma, total, w = label(m, [f"{en} {fr}"])
    said = gamma.argmax(axis=1).tolist()
    assert said == [0] * 11 + [1] * 11 and m.move[0, 0] > m.move[0, 1]
    assert abs(total.sum() - w.n) < 1e-3


def test_words():
    w = Words(["Ab, c1d", "", "é!"])
    assert w.n == 4 and w.doc.tolist() == [0, 0, 0, 2]
    assert Words(["ab"]).hash[0] == w.hash[0] and Words([""]).n == 0


def test_awkward_documents(spark):
    m = train(awkward(spark).withColumnRenamed("lang_pred", "x"))
    got = identify(awkward(spark), m).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 13)) and by[5].lang_pred == "en"
    assert by[9].lang_pred == "en" and CHAIN < Words([by[9].text]).n
    assert all(r.lang_pred == "und" for r in identify(awkward(spark), None).collect())
    assert identify(empty(spark), m).count() == 0 and train(empty(spark)) is None and keep_identified(empty(spark)).count() == 0
    kept = keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6, 7, 9, 10}
