"""Language of texts: a linear-chain conditional random field labels words in code-switched text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.suffix import Hashes
from quadrille.session import bounded_batches

__all__ = ["Model", "Words", "fit", "forward_backward", "chained_marginals", "sample", "train", "identify", "label_words", "keep_identified"]

GRAMS = (2, 3, 4)
BITS = 16
CHAIN = 64
RUN = 16
CHUNK = 1 << 19
SPACE = np.array([32 if i < 128 and not chr(i).isalpha() else i for i in range(256)], np.uint8)
WORD = regex.compile(r"[\p{L}\p{M}]+")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L (numerals such as roman or circled ones aren't)."""
    return any(map(str.isalpha, text))


def _plain(text: str) -> bytes:
    """The text lowered, with a space for each character beyond ASCII that is no letter and no mark on one."""
    text = text.lower()
    if not text.isascii():
        odd = {ord(c): " " for c in set(text) if c > "\x7f" and unicodedata.category(c)[0] not in "LM"}
        text = text.translate(odd) if odd else text
    return text.encode("utf-8", "replace")


class Words:
    """The words of some texts and their features.

    Words are runs of letters, with the marks on them, lowered. Features of
    a word are its n-grams of 2 to 4 bytes with the space before and after it, so that those
    that hold a space are prefixes and suffixes of up to three bytes; and its hash, which the
    lexicon knows or not. No feature depends on other words.
    """

    def __init__(self, texts: list[str]) -> None:
        raw = [_plain(t) for t in texts]
        buf = SPACE[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
        size = np.array([len(x) + 1 for x in raw], np.int64)
        gap = buf == 32
        keep = np.r_[True, ~(gap[1:] & gap[:-1])]
        c, at = buf[keep], np.flatnonzero(keep)
        self.first = np.flatnonzero(c[:-1] == 32)  # each word with the space before it
        self.doc = np.searchsorted(np.cumsum(size), at[self.first + 1] - 1, side="right")  # the text before may end in the same gap
        n = len(self.first)
        end = np.r_[self.first[1:], len(c) - 1] if n else self.first
        hashes = Hashes(c)
        self.hash = hashes.of(self.first + 1, end) if n else np.empty(0, np.uint64)
        body = c[:-1].astype(np.uint32)
        self.length = np.diff(np.r_[self.first, len(body)])
        inner = np.r_[c == 32, np.zeros(max(GRAMS), bool)]
        wide = np.r_[c.astype(np.uint32), np.full(max(GRAMS), 32, np.uint32)]
        self.grams, m = [], len(body)
        h, bad = body.copy(), np.zeros(m, bool)
        for k in range(1, max(GRAMS)):
            h = h * np.uint32(0x01000193) ^ wide[k : k + m]
            if k > 1:
                bad |= inner[k - 1 : k - 1 + m]
            if k + 1 in GRAMS:
                x = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
                x[bad] = 1 << BITS  # reaches into the next word
                self.grams.append(x)
        self.n = n


@dataclass
class Model:
    """Weights by language: of n-grams, of the lexicon (by sorted hash) and of transitions."""

    langs: list[str]
    gram: np.ndarray
    lexicon: np.ndarray
    entry: np.ndarray
    move: np.ndarray

    def slots(self, w: Words) -> np.ndarray:
        """The lexicon's row of each word; its last row is for unknown words."""
        i = np.searchsorted(self.lexicon, w.hash)
        i[i == len(self.lexicon)] = 0
        return np.where(self.lexicon[i] == w.hash, i, len(self.lexicon)) if len(self.lexicon) else np.zeros(w.n, np.int64)

    def emissions(self, w: Words, slots: np.ndarray) -> np.ndarray:
        s = self.gram[0][w.grams[0]]
        for table, x in zip(self.gram[1:], w.grams[1:]):
            s += table[x]
        return np.add.reduceat(s, w.first, axis=0) + self.entry[slots]


def forward_backward(score: np.ndarray, move: np.ndarray, length: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, expected transitions and log partition of padded chains (chains, steps, labels).

    ``before`` and ``after`` (chains, labels), if given, are factors on the first label and on the
    last one of each chain: the messages of what stands before and after it.
    """
    n, steps, k = score.shape
    live = np.arange(steps)[None, :] < length[:, None]
    top = score.max(axis=2, keepdims=True)
    e = np.where(live[:, :, None], np.exp(score - top), 1.0)
    m = np.exp(move)
    a, z = np.empty_like(e), np.empty((n, steps))
    for t in range(steps):
        x = (e[:, 0] if before is None else before * e[:, 0]) if t == 0 else (a[:, t - 1] @ m) * e[:, t]
        x = x if t == 0 else np.where(live[:, t, None], x, a[:, t - 1])
        z[:, t] = x.sum(axis=1)
        a[:, t] = x / z[:, t, None]
    b = np.ones((n, k)) if after is None else after
    gamma, pairs = np.empty_like(e), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        gamma[:, t] = a[:, t] * b
        gamma[:, t] /= gamma[:, t].sum(axis=1, keepdims=True)
        if t:
            right = np.where(live[:, t, None], e[:, t] * b, 0.0)
            x = a[:, t - 1][:, :, None] * m[None] * right[:, None, :]
            s = x.sum(axis=(1, 2), keepdims=True)
            pairs += (x / np.where(s > 0, s, 1.0)).sum(axis=0)
            new = right @ m.T
            b = np.where(live[:, t, None], new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300), b)
    return gamma, pairs, (np.where(live, np.log(z) + top[:, :, 0], 0.0)).sum(axis=1)


def chained_marginals(score: np.ndarray, move: np.ndarray, length: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Marginals of chains that are cut into blocks (blocks, steps, labels), as if they were whole.

    A block that ``follows`` goes on from the one before it. The product of a block's transitions
    and scores carries the forward message over it to the next block, and the backward one to
    the block before; with both, each block is solved for itself.
    """
    if not follows.any():
        return forward_backward(score, move, length)[0]
    n, steps, k = score.shape
    part = np.flatnonzero(follows | np.r_[follows[1:], False])
    s, size, m = score[part], length[part], np.exp(move)
    s = np.exp(s - s.max(axis=2, keepdims=True))
    x = np.empty((len(part), k, k))  # from each label before the block to each at its end
    for t in range(steps):
        if t == 0:
            new = np.where(follows[part, None, None], m[None], 1.0) * s[:, 0, None, :]
        else:
            new = (x.reshape(-1, k) @ m).reshape(x.shape) * s[:, t, None, :]
        live = t < size
        x[live] = (new / new.sum(axis=(1, 2), keepdims=True))[live]
    over = np.zeros((n, k, k))
    over[part] = x
    first = np.flatnonzero(~follows)
    rank = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    by = np.argsort(rank, kind="stable")
    by = np.split(by, np.cumsum(np.bincount(rank))[:-1])
    coming, after = np.ones((n, k)), np.ones((n, k))
    for i in by[1:]:
        v = (coming[i - 1][:, None, :] @ over[i - 1])[:, 0]
        coming[i] = v / v.sum(axis=1, keepdims=True)
    for i in by[:0:-1]:
        v = (over[i] @ after[i][:, :, None])[:, :, 0]
        after[i - 1] = v / v.sum(axis=1, keepdims=True)
    return forward_backward(score, move, length, np.where(follows[:, None], coming @ m, 1.0), after)[0]


def _chains(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at most CHAIN consecutive words of one document: block and step of each word, lengths."""
    if not len(doc):
        return doc, doc, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    new = (place % CHAIN == 0).astype(np.int64)
    chain = np.cumsum(new) - 1
    return chain, place % CHAIN, np.bincount(chain)


def fit(texts: list[str], langs: list[str], rounds: int = 25, rate: float = 0.15, decay: float = 1e-4, least: int = 4, seed: int = 7) -> Model:
    """Fit the field to labelled texts by its likelihood (Adam, full batch).

    A text's label is that of its words. To learn transitions as they are where languages
    switch, runs of RUN words of all texts are shuffled and chained.
    """
    names = sorted(set(langs))
    w, k = Words(texts), len(names)
    y = np.array([names.index(x) for x in langs])[w.doc]
    known, count = np.unique(w.hash, return_counts=True)
    model = Model(names, np.zeros((len(GRAMS), (1 << BITS) + 1, k), np.float32), known[count >= least], np.zeros(((count >= least).sum() + 1, k), np.float32), np.zeros((k, k)))
    slots = model.slots(w)
    pieces = np.array_split(np.arange(w.n), max(1, w.n // RUN))
    order = np.concatenate([pieces[i] for i in np.random.default_rng(seed).permutation(len(pieces))])
    chain, step, length = np.arange(w.n) // CHAIN, np.arange(w.n) % CHAIN, np.bincount(np.arange(w.n) // CHAIN)
    gold = np.eye(k)[y]
    tell = np.zeros((k, k))
    follow = chain[1:] == chain[:-1]
    np.add.at(tell, (y[order][:-1][follow], y[order][1:][follow]), 1)
    word = np.repeat(np.arange(w.n), w.length)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.gram, model.entry, model.move)]
    for r in range(1, rounds + 1):
        score = np.zeros((len(length), CHAIN, k))
        score[chain, step] = model.emissions(w, slots)[order]
        gamma, pairs, _ = forward_backward(score, model.move, length)
        g = np.empty((w.n, k))
        g[order] = gold[order] - gamma[chain, step]
        at = g[word]
        slope = np.stack([np.stack([np.bincount(x, at[:, j], (1 << BITS) + 1) for j in range(k)], 1) for x in w.grams])
        slope[:, -1] = 0
        lex = np.stack([np.bincount(slots, g[:, j], len(model.entry)) for j in range(k)], 1)
        lex[-1] = 0
        for p, (m1, m2), d in zip((model.gram, model.entry, model.move), state, (slope / w.n, lex / w.n, (tell - pairs) / w.n)):
            d = d - decay * p
            m1 += 0.1 * (d - m1)
            m2 += 0.02 * (d * d - m2)
            p += (rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.98**r)) + 1e-8)).astype(p.dtype)
    return model


def label(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Words]:
    """Marginals of every word, each text one chain however long, and the sum of each text's."""
    w = Words(texts)
    total = np.zeros((len(texts), len(model.langs)))
    if not w.n:
        return np.empty((0, len(model.langs))), total, w
    chain, step, length = _chains(w.doc)
    score = np.zeros((len(length), CHAIN, len(model.langs)), np.float32)
    score[chain, step] = model.emissions(w, model.slots(w))
    block = w.doc[np.flatnonzero(step == 0)]
    gamma = chained_marginals(score, model.move, length, np.r_[False, block[1:] == block[:-1]])[chain, step]
    for j in range(total.shape[1]):
        total[:, j] = np.bincount(w.doc, gamma[:, j], len(texts))
    return gamma, total, w


def sample(docs: DataFrame, per_lang: int = 150, most_bytes: int = 20_000) -> tuple[list[str], list[str]]:
    """Labelled texts for :func:`fit`: about ``per_lang`` of each language, of at most ``most_bytes``
    bytes each, drawn by a hash of doc_id and text from rows that are not held out."""
    rows = docs.where("text is not null and lang is not null").where(F.octet_length("text") <= most_bytes).where(fold() != 2)
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], []
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, per_lang / n))) for x, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    got = sorted((r[2], r[0], r[1]) for r in rows.select("text", "lang", draw.alias("draw")).where(F.col("draw") < share).limit(4 * per_lang * len(sizes)).collect())
    return [x[1] for x in got], [x[2] for x in got]


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def train(docs: DataFrame, per_lang: int = 150) -> Model | None:
    """A model of the labelled rows of ``docs`` that are not held out; None if there are none."""
    texts, langs = sample(docs, per_lang)
    return fit(texts, langs) if any(map(has_letter, texts)) else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``, from the whole text alone.

    Each word gets its marginals in the chain of all of the text's words; the text's language is
    that of the largest sum (ties: the first by name) and the score its mean. Texts that are null
    or hold no letter (Unicode's category L) are ``und`` with score 0, as is every text if there is
    no model. One pass, no shuffle; columns of ``docs`` named as a result are replaced. Repeated
    rows give repeated rows, an empty table an empty result.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in own]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            some: list[tuple[int, str]] = []
            held = 0

            def flush() -> None:
                _, total, _ = label(model, [t for _, t in some])
                best = total.argmax(axis=1)
                whole = np.maximum(total.sum(axis=1), 1e-12)
                for (i, _), j, s in zip(some, best.tolist(), (total[np.arange(len(some)), best] / whole).tolist()):
                    pred[i], score[i] = model.langs[j], min(1.0, s)

            for i, t in enumerate(b.column("text")):
                t = t.as_py()
                if t is None or model is None or not has_letter(t):
                    continue
                some.append((i, t))
                held += len(t)
                if held >= CHUNK:
                    flush()
                    some, held = [], 0
            if some:
                flush()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, StructType([*own, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add ``words`` to ``docs``: start and length in code points, language and its marginal, for each word.

    For code-switched text: labels are those of the most likely language of each word in the
    chain of the whole text. Null texts, texts without letters and all texts without a model
    get an empty array. A column of ``docs`` of that name is replaced.
    """
    own = [f for f in docs.schema.fields if f.name != "words"]
    names = [f.name for f in own]
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[dict]] = []
            for t in b.column("text").to_pylist():
                out.append([])
                found = [] if t is None or model is None else [x for x in WORD.finditer(t) if has_letter(x[0])]
                if found:
                    gamma = label(model, [" ".join(x[0] for x in found)])[0]
                    best = gamma.argmax(axis=1)
                    score = gamma[np.arange(len(best)), best].tolist()
                    out[-1] = [{"start": x.start(), "length": len(x[0]), "lang": model.langs[j], "score": min(1.0, p)} for x, j, p in zip(found, best.tolist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, kind)], names=[*names, "words"])

    from pyspark.sql.types import StructType

    words = StructType.fromDDL("words array<struct<start: int, length: int, lang: string, score: double>>")
    return docs.select(*names).mapInArrow(run, StructType([*own, *words.fields]))


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is found with a score of ``least``."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # columns named as a result stay
    return identify(rows, train(docs)).where(F.col("lang_pred") != "und").where(F.col("score") >= least).select("row.*")
