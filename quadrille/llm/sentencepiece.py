"""SentencePiece models on the tokenizers library: protobuf parsing, rebuilding, encoding and decoding."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.packing import TextTokens
from quadrille.session import bounded_batches

__all__ = ["Spec", "parse_model", "build", "encode", "decode", "Coder", "encode_documents"]

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PART = 1 << 21
LINE = 1024


@dataclass(frozen=True)
class Spec:
    """What a model file says: pieces (text, score, kind) by id, and how texts are normalised."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @property
    def split_at_mark(self) -> bool:
        """No piece has the marker after another character, so none reaches across such a place."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in self.pieces if k in (NORMAL, USER))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if i >= len(b):
            raise ValueError("the model file breaks off")
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            if wire == 2:
                n, i = _varint(b, i)
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} is not known")
            if i + n > len(b):
                raise ValueError("the model file breaks off")
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def parse_model(data: bytes) -> Spec:
    """The model in a serialised protobuf: pieces (1), trainer (2) and normaliser (3) settings."""
    pieces, trainer, norm = [], {}, {}
    for f, v in _fields(data):
        if f == 1:
            piece = dict(_fields(v))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif f == 2:
            trainer = dict(_fields(v))
        elif f == 3:
            norm = dict(_fields(v))
    if not pieces:
        raise ValueError("the model has no pieces")
    return Spec(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))


def build(spec: Spec):
    """A ``tokenizers.Tokenizer`` that gives the model's ids.

    Unigram models keep their scores. BPE models are given as merges: every split of a piece
    into two pieces, in order of the whole piece's score.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = spec.pieces[spec.unk_id][0]
    if spec.kind == UNIGRAM:
        # an unknown character costs ten more than the worst piece; only normal ones count for that
        worst = min((s for _, s, k in spec.pieces if k == NORMAL), default=0.0)
        model = models.Unigram([(p, s if k in (NORMAL, USER) else worst) for p, s, k in spec.pieces], unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        usable = {p for p, _, k in spec.pieces if k in (NORMAL, USER, UNUSED)}
        merges = []
        for i in sorted((i for i, x in enumerate(spec.pieces) if x[2] == NORMAL), key=lambda i: -spec.pieces[i][1]):
            p = spec.pieces[i][0]
            pairs = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges += sorted(pairs, key=lambda x: (ids[x[0]], ids[x[1]]))
        model = models.BPE(ids, merges, unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if spec.split_at_mark:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    t.add_tokens([AddedToken(p, normalized=False) for p, _, k in spec.pieces if k == USER])
    chain = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(chain + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return t


def encode(tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids of each text; the library's own threads share the batch."""
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def decode(tokenizer, ids: list[list[int]]) -> list[str]:
    return tokenizer.decode_batch(ids, skip_special_tokens=False)


class Coder:
    """Ids and texts of whole batches; the library encodes each distinct word of a batch once, in
    lines of LINE words, by all its threads.

    Where no piece reaches across the place before a marker, a text of words with one space
    between them is the chain of its words, each with the marker in front. Texts with other
    spacing, and all texts of models with more to normalise, go through the library whole.
    """

    HELD = 400_000

    def __init__(self, path: str, threads: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            self.spec = parse_model(f.read())
        self.tokenizer, self.own, self.threads = build(self.spec), SentencePieceProcessor(model_file=path), threads
        s = self.spec
        self.by_word = s.split_at_mark and s.dummy_prefix and s.escape and not s.squeeze and not s.charsmap and not any(k == USER for _, _, k in s.pieces)
        self.opens = np.array([p.startswith(MARK) for p, _, _ in s.pieces])
        self.words: dict[str, bytes] = {}
        self.lost: set[str] = set()  # words that don't come back

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        return self.checked(texts)[:2]

    def checked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, each text's number of ids, and whether the library's decoder gives the text back.

        Lines of new words and odd texts are decoded as they are; a text of words comes back if
        all its words do, since nothing in a decoder reaches over a marker.
        """
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}") if self.by_word else pa.array(np.ones(len(texts), bool))
        words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = pc.dictionary_encode(words.flatten())
        known = coded.dictionary.to_pylist()
        if len(self.words) > self.HELD:  # bounds what a worker keeps
            self.words, self.lost = {}, set()
        self.words[""] = b""
        new = [w for w in known if w not in self.words]
        rest = texts.filter(odd).to_pylist()
        lines = [" ".join(new[a : a + LINE]) for a in range(0, len(new), LINE)]
        both = encode(self.tokenizer, lines + rest)  # one batch for the library's threads
        back = decode(self.tokenizer, both)
        whole = both[len(lines) :]
        if new:
            got = np.concatenate([np.array(x, "<u4") for x in both[: len(lines)]])
            cuts = np.flatnonzero(self.opens[got]).tolist() + [len(got)]  # each word begins with a piece that has the marker in front
            raw = got.tobytes()
            self.words.update((w, raw[4 * a : 4 * z]) for w, a, z in zip(new, cuts[:-1], cuts[1:], strict=True))
            for line, text in zip(lines, back):
                if line != text:
                    self.lost.update(w for w in line.split(" ") if decode(self.tokenizer, [np.frombuffer(self.words[w], "<u4").tolist()]) != [w])
        packed = [*(self.words[w] for w in known), *(np.array(i, "<u4").tobytes() for i in whole)]
        flat = np.frombuffer(b"".join(packed), "<u4")
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        # an odd text is one empty word: put its own ids there
        at = words.offsets.to_numpy() - words.offsets[0].as_py()
        word = coded.indices.to_numpy().astype(np.int64)
        word[at[:-1][odd.to_numpy(zero_copy_only=False)]] = len(known) + np.arange(len(whole))
        bad = np.array([*(w in self.lost for w in known), *(x != t.replace(MARK, " ") for x, t in zip(back[len(lines) :], rest))], bool)
        ends = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[word])))[at])
        return TextTokens.gather(flat, size, word), ends(size), ends(bad.astype(np.int64)) == 0

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as bytes, by the library's decoder."""
        return [x.encode() for x in decode(self.tokenizer, [i.tolist() for i in np.split(ids, np.cumsum(n)[:-1])])]


@lru_cache(maxsize=2)
def coder(path: str, threads: int) -> Coder:
    """One for each worker process."""
    return Coder(path, threads)


def encode_documents(docs: DataFrame, path: str, threads: int = 2, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and compare with the model's own library.

    Returns ``doc_id, n_tokens, ids_crc32`` (of little-endian unsigned 32-bit ids),
    ``round_trip`` (the decoded text is the text, the marker read as a space), ``parity`` (the
    model's own library gives the same ids; with a unigram model it sums scores over a whole text
    in single precision and may take another way far on in a long one) and, if asked for, ``ids``. Null texts count as
    empty: no tokens. Repeated rows give repeated rows, an empty table an empty result; other
    columns of ``docs`` are ignored, whatever their names. One pass, no shuffle; batches of about
    two megabytes go to the library at once, and what it encodes is decoded by it.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, threads)
        for b in batches:
            texts = b.column(1).cast(pa.string())
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PART, side="right")))
                part = texts.slice(a, z - a)
                ids, n, trip = c.checked(part)
                plain = part.to_pylist()
                runs = np.split(ids, np.cumsum(n)[:-1])
                lists = [i.tolist() for i in runs]
                same = [i == j for i, j in zip(lists, c.own.encode(plain, num_threads=threads))]
                crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in runs]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(trip), pa.array(same, pa.bool_()), *[pa.array(lists, pa.list_(pa.int32()))] * with_ids], names=[x.split()[0] for x in schema.split(", ")])
                a = z

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
