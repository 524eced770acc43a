import numpy as np
from cases import awkward, empty

from quadrille.llm.langid import CHAIN, Words, chained_marginals, fit, forward_backward, has_letter, identify, label, label_words

EN = "the house and the garden with some other people walking there"
FR = "la maison et le jardin avec quelques autres gens qui marchent"


def model():
    turn = lambda t, i: " ".join(t.split()[i:] + t.split()[:i])
    return fit([turn(t, i) for t in (EN, FR) for i in range(11)] * 3, (["en"] * 11 + ["fr"] * 11) * 3)


def test_blocks_give_the_whole_chain_s_marginals():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sizes = rng.integers(1, 40, 6)
        move = rng.normal(size=(3, 3)) * 2
        steps, blocks, length, follows, want = 4, [], [], [], []
        for n in sizes:
            s = rng.normal(size=(n, 3)) * 2
            want.append(forward_backward(s[None], move, np.array([n]))[0][0])
            for a in range(0, n, steps):
                x = np.zeros((steps, 3))
                x[: len(s[a : a + steps])] = s[a : a + steps]
                blocks.append(x)
                length.append(min(steps, n - a))
                follows.append(a > 0)
        got = chained_marginals(np.array(blocks), move, np.array(length), np.array(follows))
        got = np.concatenate([g[:n] for g, n in zip(got, length)])
        assert np.abs(got - np.concatenate(want)).max() < 1e-9


def test_a_long_text_is_one_chain():
    m = model()
    texts = [" ".join([EN, FR] * 9), "", EN, FR * 20]
    gamma, total, w = label(m, texts)
    at = 0
    for i, t in enumerate(texts):
        own = Words([t])
        if not own.n:
            continue
        score = m.emissions(own, m.slots(own)).astype(np.float32)
        want = forward_backward(score[None], m.move, np.array([own.n]))[0][0]
        assert np.abs(gamma[at : at + own.n] - want).max() < 1e-5 and np.abs(total[i] - want.sum(axis=0)).max() < 1e-3
        at += own.n
    assert at == w.n and max(np.bincount(w.doc)) > CHAIN


def test_letters_are_of_category_l(spark):
    odd = ["½", "²", "①", "Ⅷ", "— “”", "12 · ½"]
    assert not any(map(has_letter, odd)) and all(map(has_letter, ["a", "ß", "漢", "½ x", "ª"]))
    assert Words(["don—“t” ①x½y"]).n == 4 and Words(odd).n == 0
    got = identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model()).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_spans_of_words(spark):
    text = f"¿{EN}? — 12 {FR}!"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "½"), (1, text)], "doc_id long, text string")
    rows = label_words(docs, model()).collect()
    by = {r.doc_id: r.words for r in rows}
    assert len(rows) == 4 and by[2] == by[3] == []
    assert [text[w.start : w.start + w.length] for w in by[1]] == (EN + " " + FR).split()
    assert [w.lang for w in by[1]] == ["en"] * 11 + ["fr"] * 11 and all(0.5 < w.score <= 1 for w in by[1])
    assert label_words(empty(spark), model()).count() == 0
    assert {w.lang for r in label_words(awkward(spark), model()).collect() for w in r.words} <= {"en", "fr"}
    assert all(r.words == [] for r in label_words(awkward(spark), None).collect())


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, EN, 0.5, "zz")] * 3, "doc_id long, text string, score double, lang_pred string")
    got = identify(docs, model()).collect()
    assert len(got) == 3 and {(r.lang_pred, r.score) for r in got} == {("en", got[0].score)}
    assert identify(docs, model()).columns == ["doc_id", "text", "lang_pred", "score"]
