"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import bounded_batches, cut

__all__ = ["sum_of_squares", "pack_lengths", "TextTokens", "token_pieces", "pack"]

CAPACITY = 4096
GROUP_TOKENS = 1 << 25


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY, limit: int | None = None) -> np.ndarray:
    """Bin of each item, placed in the order given (Csirik et al. 2006).

    With N(g) open bins of residual gap g, an item goes where the sum of N(g)^2 becomes
    smallest: into the gap g of largest N(g) - N(g - size), or a new bin; ties take the
    smallest gap. Full bins (gap 0) don't count. Sizes are 1 to capacity. Once there are ``limit``
    bins, a new one is opened only for an item that fits in none.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # change of the sum, halved: N(g - s) - N(g) + 1, or half a new bin's 2 N(capacity - s) + 1
        gain = np.where(count[s:capacity] > 0, count[: capacity - s] - count[s:capacity] + 1.0, np.inf) if s < capacity else np.empty(0)
        if len(gain) and count[s]:
            gain[0] = 0.5 - count[s]  # the bin becomes full and leaves the sum
        fresh = count[capacity - s] + 0.5 if s < capacity else 0.0
        k = int(gain.argmin()) if len(gain) else -1
        if k >= 0 and gain[k] < np.inf and (gain[k] <= fresh or (limit is not None and made >= limit)):
            g = s + k
            b = bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
        out[i] = b
    return out


def pack_lengths(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item, as few bins as it can: largest first by the sum-of-squares rule.

    The rule opens bins freely up to the number that the sizes' sum asks for at least; from then
    on it chooses among the open ones as long as an item fits in any.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    out[order] = sum_of_squares(sizes[order], capacity, -(-int(sizes.sum()) // capacity))
    return out


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: the open bin of least sufficient gap, else a new one. A measure for :func:`pack_lengths`."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit g: some bin has gap g
    out, made = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fit = mask >> s
        if fit:
            g = s + (fit & -fit).bit_length() - 1
            b = bins[g].pop()
            if not bins[g]:
                mask &= ~(1 << g)
        else:
            g, b, made = capacity, made, made + 1
        if g > s:
            bins[g - s].append(b)
            mask |= 1 << (g - s)
        out[i] = b
    return out


class TextTokens:
    """Token ids of texts, each distinct word encoded once.

    Right only for a tokenizer that drops white space, lowers case and lets no token reach
    across white space; for others the texts are encoded whole. A word's closing marks after
    a letter or digit are a token run of their own, so the word is looked up without them.
    """

    MARKS = ".,;:!?"
    HELD = 300_000
    PART = 1 << 22

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, kinds = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        added = spec.get("added_tokens", ())
        self.special = tuple({x["content"][:2] for x in added})
        self.by_word = "\\\\s\\\\p{L}" in rule and '"Removed"' in rule and '"Lowercase"' in kinds and not any(x.get("lstrip") or x.get("rstrip") or any(c.isspace() for c in x["content"]) for x in added)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.stems: dict[str, bytes] = {"": b""}
        # letters alone are one run, which the model takes as it is but for its names of bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}

    def learn(self, stems: Iterable[str]) -> None:
        rest, run = [], self.tokenizer.model.tokenize
        for x in stems:
            if x.isalpha() and (x.isascii() or (x == x.lower() and unicodedata.is_normalized("NFC", x))):
                y = x if x.isascii() else x.encode().decode("latin-1").translate(self.bytes)
                self.stems[x] = array(self.code, [t.id for t in run(y)]).tobytes()
            else:
                rest.append(x)
        self.stems.update(zip(rest, (array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and each word's number of ids."""
        if len(self.stems) > self.HELD:  # bounds what a worker keeps
            self.stems = {"": b""}
        special = pc.match_substring(words, self.special[0]) if self.special else pa.array(np.zeros(len(words), bool))
        for x in self.special[1:]:
            special = pc.or_(special, pc.match_substring(words, x))
        low = pc.ascii_lower(words)
        stem = pc.ascii_rtrim(low, characters=self.MARKS)
        apart = pc.and_not(pc.utf8_is_alnum(pc.utf8_slice_codeunits(stem, -1)), special)
        stem = pc.dictionary_encode(pc.if_else(apart, stem, pc.if_else(special, words, low)))
        mark = pc.dictionary_encode(pc.if_else(apart, pc.replace_substring_regex(low, f"^.*?([{self.MARKS}]*)$", r"\1"), ""))
        both, get = [*stem.dictionary.to_pylist(), *mark.dictionary.to_pylist()], self.stems
        self.learn({x for x in both if x not in get})
        flat, size = self.packed([get[x] for x in both])
        pair = np.stack([stem.indices.to_numpy(), mark.indices.to_numpy() + len(stem.dictionary)], 1).ravel()
        return self.gather(flat, size, pair), size[pair].reshape(-1, 2).sum(axis=1)

    def packed(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(ids), self.code)
        return flat, np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize

    @staticmethod
    def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The runs of ``flat`` of the given sizes, by index, one after the other."""
        n = size[index]
        end = np.cumsum(n)
        return flat[np.arange(end[-1] if len(end) else 0) + np.repeat((np.cumsum(size) - size)[index] - (end - n), n)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn. Texts are taken a few megabytes at a time, longer ones
        in parts that end at white space."""
        if not self.by_word:
            for t in texts:
                yield np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, np.uint32)
            return
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        a = 0
        while a < len(texts):
            z = a + max(1, int(np.searchsorted(np.cumsum(size[a:]), self.PART, side="right")))
            if size[a] <= self.PART:
                ids, n = self.some(texts.slice(a, z - a))
                yield from np.split(ids, np.cumsum(n)[:-1])
            else:
                t, at, found = texts[a].as_py(), 0, []
                while at < len(t):
                    end = at + self.PART
                    while end < len(t) and t[end] not in " \n":
                        end += 1
                    found.append(self.some(pa.array([t[at:end]]))[0])
                    at = end
                yield np.concatenate(found)
            a = z

    def some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids."""
        words = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(words.flatten())
        offsets = words.offsets.to_numpy().astype(np.int64)
        flat, size = self.lookup(coded.dictionary)
        word = coded.indices.to_numpy()
        at = np.concatenate(([0], np.cumsum(size[word])))[offsets - offsets[0]]
        return self.gather(flat, size, word), np.diff(at)


@lru_cache(maxsize=2)
def coder(path: str) -> TextTokens:
    """One for each worker process, which keeps the words that it has met."""
    return TextTokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and ``end_id``,
    cut at every ``capacity`` tokens. Null texts count as empty; each row counts for itself."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(coder(path).encode(b.column(1).cast(pa.string()))):
                x = np.append(x, end_id).astype("<u4")
                for k, a in enumerate(range(0, len(x), capacity)):
                    part = x[a : a + capacity]
                    for o, v in zip((row, piece, start, length, crc), (i, k, a, len(part), zlib.crc32(part.tobytes()))):
                        o.append(v)
                    if with_ids:
                        ids.append(part.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Adds ``sequence_id`` and ``offset`` (gapless from 0 in a sequence) to :func:`token_pieces`.
    Pieces are dealt by hash into groups of about ``group_tokens`` tokens (thousands of
    sequences, so that a group's last open bins don't matter) and each group is packed for
    itself. Only lengths go through the packing.
    Empty texts give one piece, the end id. An empty table gives an empty result.
    """
    pieces = cut(token_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    bounded_batches(docs.sparkSession, rows=65536)
    # equal rows are told apart by nothing but their count, so any of them may take any place
    g = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("g")
    dealt = pieces.select(*pieces.columns, g).repartition(groups, "g").sortWithinPartitions("g", F.desc("length"), "doc_id", "piece", "ids_crc32")
    kind = dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(t: pa.Table) -> pa.Table:
            size = t.column("length").to_numpy()
            b = pack_lengths(size, capacity)
            order = np.argsort(b, kind="stable")
            end = np.cumsum(size[order])
            first = np.r_[True, b[order][1:] != b[order][:-1]]
            begin = end - size[order]
            offset = np.empty(len(b), np.int64)
            offset[order] = begin - np.maximum.accumulate(np.where(first, begin, 0))
            seq = (t.column("g").to_numpy().astype(np.int64) << 32) + b
            return t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                g = b.column("g").to_numpy()
                if held and held[-1].column("g")[0].as_py() != g[0]:
                    yield from packed(pa.Table.from_batches(held)).to_batches()
                    held = []
                n = int(np.searchsorted(g, g[0], side="right"))
                held.append(b.slice(0, n))
                b = b.slice(n)
        if held:
            yield from packed(pa.Table.from_batches(held)).to_batches()

    schema = ", ".join(f"{c} {k}" for c, k in kind.items()) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)
