"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.suffix import Hashes, _mix
from quadrille.session import bounded_batches, cut

__all__ = ["shingle_hashes", "bin_minima", "fingerprint", "likeness", "with_fingerprints", "edited_neighbours"]

WIDTH = 5
BINS = 256
KEPT = 4
PIECE = 1 << 20
_probe = np.random.default_rng(611953).integers(0, BINS, (4096, BINS))


def _pieces(raw: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text, in runs that overlap by ``width - 1`` words."""
    held: list[bytes] = []
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\r\v\f":
            end += 1
        words = held + raw[at:end].lower().split()
        yield words
        held, at = words[-width + 1 :] if width > 1 else [], end


def shingle_hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of a text's ``width``-word shingles, sorted.

    A-Z are lowered, words are runs outside ASCII white space. Fewer words: the whole sequence
    is the only shingle; none: no hash.
    """
    out = []
    for words in _pieces(raw, width):
        if not words:
            continue
        w = min(width, len(words))
        if w < width and out:
            continue
        end = np.cumsum([len(x) + 1 for x in words]) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        h = Hashes(np.frombuffer(b" ".join(words), np.uint8))
        out.append(np.sort(_mix(h.of(start[: len(words) - w + 1], end[w - 1 :]))))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def bin_minima(h: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS bins, from a sorted, non-empty set of distinct hashes.

    Each shingle is hashed once: the top bits name its bin. An empty bin takes the value of the
    first full bin on its own pseudo-random probe sequence (Shrivastava 2017), which depends on
    nothing but the bin.
    """
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edge = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << shift)
    full = np.r_[edge[1:], len(h)] > edge
    value = h[np.minimum(edge, len(h) - 1)]
    source = np.arange(BINS)
    todo = np.flatnonzero(~full)
    for a, z in ((0, 8), (8, 128), (128, 4096)):
        if len(todo):
            hit = full[_probe[a:z, todo]]
            found = hit.any(axis=0)
            source[todo[found]] = _probe[a:z][hit.argmax(axis=0)[found], todo[found]]
            todo = todo[~found]
    source[todo] = np.flatnonzero(full)[0]
    return value[source]


def fingerprint(raw: bytes, width: int = WIDTH) -> bytes:
    """BINS values of KEPT bits, the low ones of :func:`bin_minima`, packed; empty for a text without words."""
    h = shingle_hashes(raw, width)
    if not len(h):
        return b""
    low = (bin_minima(h) & np.uint64((1 << KEPT) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity, 0 to 1: the share of equal values, less what low-order bits
    share by chance. Two empty fingerprints are alike, one is like no other."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = (int((x >> 4 == 0).sum()) + int((x & 15 == 0).sum())) / BINS
    chance = 1 / (1 << KEPT)
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fingerprint)`` of every row, nulls as empty texts; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(x or b"", width) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), prints], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fingerprint binary")


def _edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_neighbours(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to each other and to the next text.

    Edited: the last half of the code points (rounded down) gives way to as many of the next
    document's first ones. Next is by descending doc_id, nulls last, ties by a hash of the text
    and the text; after the last comes the first. The rows are range-partitioned and sorted,
    which moves each text once; only the last row of a partition has to meet the first of the
    next one, and those two rows a partition are joined by partition number.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (binary),
    ``near_edited, near_next``. Null texts count as empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    names = [x.split()[0] for x in facts.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    order = [F.desc_nulls_last("doc_id"), F.asc("th")]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.xxhash64("text").alias("th")).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def fact(text: str, print_: bytes, after: str, next_print: bytes) -> tuple:
        edited = _edit(text, after).encode()
        e = fingerprint(edited, width)
        return len(text), hashlib.sha256(edited).digest(), print_, e, likeness(print_, e), likeness(print_, next_print)

    def columns(found: list[tuple]) -> list[pa.Array]:
        return [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, head, last = TaskContext.get().partitionId(), None, None
        extra = [*names, "pid", "head", "tail"]
        for b in batches:
            ids = [] if last is None else [last[0]]
            found = []
            for i, t in enumerate(b.column(1).to_pylist()):
                p = fingerprint(t.encode(), width)
                if last is None:
                    head = t
                else:
                    found.append(fact(last[1], last[2], t, p))
                last = (b.column(0).slice(i, 1), t, p)
            ids.append(b.column(0).slice(0, b.num_rows - 1))
            if found:
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns(found), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=extra)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last[0], *(pa.nulls(1, k) for k in kinds), pa.array([pid], pa.int32()), pa.array([head]), pa.array([last[1]])], names=extra)

    all_ = cut(rows.select("doc_id", "text").mapInArrow(run, f"{facts}, pid int, head string, tail string"), "neighbours")
    ends = all_.where("pid is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("pid")  # one row a partition, without texts
    chain = ends.select("pid").select("pid", F.coalesce(F.lead("pid").over(w), F.first("pid").over(w)).alias("then"))
    pairs = ends.select("doc_id", "tail", "pid").join(chain, "pid").join(ends.select(F.col("pid").alias("then"), "head"), "then")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fact(t, fingerprint(t.encode(), width), h, fingerprint(h.encode(), width)) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(found)], names=names)

    return all_.where("pid is null").select(*names).union(pairs.select("doc_id", "tail", "head").mapInArrow(finish, facts))
