"""Removal of repeated byte strings by suffix order and longest previous factors, over a whole corpus.

A suffix array of a corpus fits no machine, so the suffixes are first dealt into groups that
equal strings of ``length`` bytes cannot leave: every such string ("window") is filed under
the hash of its minimiser, the leftmost least of its 64-byte grams. Consecutive windows with
the same minimiser make one *stretch*, kept once however often it occurs. Only stretches
whose minimiser occurs again are fetched; per group their starts are put in suffix order, the
bytes that neighbours share are counted, and the previous and next smaller places in that
order give each start its longest previous factor and where that stands. A start repeats an
earlier one where the factor reaches ``length``.

A group of over ``HOT`` bytes never comes together: its stretches are cut into pieces of SUB
windows, equal pieces are merged by digest, and windows of pieces that only share their middle
are aggregated by digest, one narrow row each. Digests are 128 bits of BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.session import bounded_batches, cut

__all__ = ["longest_previous_factor", "previous_factors", "suffix_order", "hashed_order", "repeated_ranges", "remove_repeats", "deduplicate"]

LENGTH = 400
GRAM = 64
CHUNK = 1 << 20
POOL = 1 << 20
HOT = 1 << 22
SUB = 16

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        n = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _POW.append(np.multiply.accumulate(x))
        _POW[:] = _POW[-2:]
    return _POW[0], _POW[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substring of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray) -> None:
        power, self.inverse = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def _stretches(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of segments [begin, end) of a buffer: first window, number of windows, place against the
    minimiser and its hash, for each stretch."""
    width, hashes = length - gram + 1, Hashes(buf)
    i = np.arange(len(buf) - gram + 1)
    low = np.uint64((1 << 24) - 1)
    g = _mix((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.inverse[: len(i)])
    g = np.concatenate(((g & ~low) | i.astype(np.uint64), np.full(-len(g) % width + width, ~np.uint64(0))))
    rows = g.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    size = end - begin - length + 1
    w = np.arange(size.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    at = (np.minimum(tail[w], head[w + width - 1]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (w[1:] != w[:-1] + 1)])
    n = np.diff(np.r_[first, len(w)])
    lo, at = w[first], at[first]
    return lo, n, lo - at, _mix(hashes.of(at, at + gram))


def _digest(x: bytes | memoryview) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _file(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Stretches of all texts: (k, th, pos, n, rel, core, f1, f2), the last two by content, n and rel."""

    def emit(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        size = np.array([len(x[3]) for x in parts])
        end = np.cumsum(size)
        begin = end - size
        raw = b"".join(x[3] for x in parts)
        lo, n, rel, core = _stretches(np.frombuffer(raw, np.uint8), begin, end, length, gram)
        view = memoryview(raw)
        f1, f2 = _halves([_digest(view[a:z]) for a, z in zip(lo.tolist(), (lo + n + length - 1).tolist())])
        f1 = f1 ^ _mix((rel << 20 | n).astype(np.uint64)).view(np.int64)
        of = np.searchsorted(begin, lo, side="right") - 1
        k, th, off = (np.array([x[i] for x in parts], np.int64)[of] for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (k, th, off + lo - begin[of], n.astype(np.int32), rel.astype(np.int32), core.view(np.int64), f1, f2)],
            names=["k", "th", "pos", "n", "rel", "core", "f1", "f2"],
        )

    parts: list[tuple[int, int, int, bytes]] = []
    held = 0
    for b in batches:
        for k, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = text.as_buffer() if text.is_valid else b""
            for a in range(0, len(raw) - length + 1, CHUNK):
                x = bytes(raw[a : a + CHUNK + length - 1])
                parts.append((k, th, a, x))
                held += len(x)
                if held >= CHUNK:
                    yield emit(parts)
                    parts, held = [], 0
    if parts:
        yield emit(parts)


def _words(buf: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end, for ``more`` places beyond it."""
    padded = np.zeros(len(buf) + more + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + more, ">u8", padded, strides=(1,)).astype(np.uint64)


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each value, equal ones share theirs."""
    by = np.argsort(key)
    key = key[by]
    rank = np.empty(len(key), np.int32)
    rank[by] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=np.int32) if len(key) else 0
    return rank


def suffix_order(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the given starts to ``depth`` bytes, ties by place, and their ranks.

    Prefix doubling from eight-byte words; equal ranks mean equal ``depth``-byte strings.
    Bytes after the end sort as zeros. About 30 bytes of memory a byte.
    """
    d = min(8, depth)
    word = _words(buf, depth)
    if d < 8:
        word >>= np.uint64(64 - 8 * d)
    rank = _dense(word)
    del word
    while d < depth:
        step = min(d, depth - d)
        last = d + step == depth
        pair = (rank[starts] if last else rank).astype(np.int64)
        pair <<= 32
        if last:
            pair |= rank[starts + step]
        else:
            pair[:-step] |= rank[step:]
        d += step
        rank = _dense(pair)
    if len(rank) != len(starts):
        rank = rank[starts]
    return np.lexsort((starts, rank)), rank


def hashed_order(buf: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`suffix_order` (equal ranks: equal strings, ties by place), in an order of hashes.

    For callers who want equal strings and no order of bytes: what it holds goes with the
    starts and not with every byte. Strings of one hash are compared; should they differ, the
    suffix order itself decides. :func:`deduplicate` doesn't use it.
    """
    h = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # starts grow, so a run of them spans a bounded piece
        z = int(np.searchsorted(starts, starts[a] + CHUNK, side="left"))
        low = starts[a]
        h[a:z] = Hashes(buf[low : starts[z - 1] + depth]).of(starts[a:z] - low, starts[a:z] - low + depth)
        a = z
    order = np.lexsort((starts, h))
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    views = np.lib.stride_tricks.sliding_window_view(buf, depth)
    for k in range(0, len(same), 4096):
        i = same[k : k + 4096]
        if not (views[starts[order[i]]] == views[starts[order[i + 1]]]).all():
            return suffix_order(buf, starts, depth)
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    rank = np.empty(len(starts), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def _shared(buf: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes from the places p and q on are equal, up to ``depth`` and the end; eight at a time."""
    word = _words(buf, depth)
    out = np.full(len(p), depth, np.int64)
    live = np.arange(len(p))
    for d in range(0, depth, 8):
        x = word[p[live] + d] ^ word[q[live] + d]
        off = np.flatnonzero(x)
        if len(off):
            x, bytes_ = x[off], np.zeros(len(off), np.int64)
            for k in range(1, 8):
                bytes_ += x < np.uint64(1) << np.uint64(64 - 8 * k)
            out[live[off]] = d + bytes_
            live = np.delete(live, off)
        if not len(live):
            break
    return np.minimum(np.minimum(out, depth), len(buf) - np.maximum(p, q))


def _smaller(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each rank the last rank before it with a smaller place (-1: none), and what both share.

    ``shared`` is of ranks r - 1 and r. All ranks jump at once, each over what the rank that it
    has come to has jumped over already.
    """
    n = len(place)
    at = np.r_[-1, place]  # a place before all others, which shares nothing
    to, m = np.r_[0, np.arange(n)], np.r_[0, shared]
    live = np.arange(1, n + 1)
    while len(live := live[(at[to[live]] > at[live]) & (m[live] > 0)]):
        over = to[live]
        m[live] = np.minimum(m[live], m[over])
        to[live] = to[over]
    m[at[to] > at] = 0  # given up: nothing shared
    return to[1:] - 1, m[1:]


def previous_factors(buf: np.ndarray, starts: np.ndarray, depth: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the starts (growing places of a buffer), the longest string there, up to ``depth``
    bytes, that also starts at a smaller start, and the index of that one (-1: nothing shared).

    The candidates are the previous and the next smaller places in suffix order (Crochemore
    and Ilie 2008); what they share with the start is the least of what neighbours in
    between share, and that is counted byte by byte.
    """
    n = len(starts)
    if order is None:
        order = suffix_order(buf, starts, depth)[0]
    shared = np.zeros(n, np.int64)
    shared[1:] = _shared(buf, starts[order[:-1]], starts[order[1:]], depth)
    before, left = _smaller(order, shared)
    after, right = _smaller(order[::-1], np.r_[0, shared[:0:-1]])
    after, right = n - 1 - after[::-1], right[::-1]
    longest = np.maximum(left, right)
    source = np.where(left >= right, before, after)
    source = np.where(longest > 0, order[np.clip(source, 0, n - 1)], -1)
    out, by = np.empty(n, np.int64), np.empty(n, np.int64)
    out[order], by[order] = longest, source
    return out, by


def longest_previous_factor(text: bytes) -> list[int]:
    """For each place of a whole text, the longest string there that also starts earlier (overlaps count)."""
    buf, every = np.frombuffer(text, np.uint8), np.arange(len(text))
    if not len(text):
        return []
    rank = suffix_order(buf, every, len(text))[1]
    return previous_factors(buf, every, len(text), np.lexsort((-every, rank)))[0].tolist()  # of equal ones the shorter suffix is less


def _match(rows: list[tuple[int, int, int, int, bytes]], length: int, keep_first: bool) -> list[tuple[int, int, int, int]]:
    """Repeated windows among stretches (k, th, pos, n, bytes): runs (k, th, pos, n)."""
    rows.sort(key=lambda x: x[:3])
    size = np.array([len(x[4]) for x in rows])
    base = np.cumsum(size) - size
    n = np.array([x[3] for x in rows])
    starts = np.arange(n.sum()) + np.repeat(base - (np.cumsum(n) - n), n)
    longest, source = previous_factors(np.frombuffer(b"".join(x[4] for x in rows), np.uint8), starts, length)
    hit = longest >= length
    if not keep_first:
        hit[source[hit]] = True  # of equal windows each but the first points to an earlier one, so the first is met too
    of = np.repeat(np.arange(len(rows)), n)
    i = np.flatnonzero(hit)
    if not len(i):
        return []
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (of[i[1:]] != of[i[:-1]])])
    count = np.diff(np.r_[first, len(i)])
    return [(rows[r][0], rows[r][1], rows[r][2] + int(s), int(c)) for r, s, c in zip(of[i[first]].tolist(), starts[i[first]] - base[of[i[first]]], count)]


def _keyed(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """Rows with a key: doc_id and a hash of doc_id and text; repeated rows share theirs."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(*keep, k.alias("k"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("th"))


def _elsewhere(rows: DataFrame, key: list[str], keep_first: bool) -> DataFrame:
    """``(k, th, pos, n)`` of the rows whose key also stands at another place; all but the first, or all.

    The least and the greatest place come from map-side aggregates; a key with very many rows is
    then joined by plain shuffles, which can be split.
    """
    place = F.struct("k", "th", "pos")
    ends = cut(rows.groupBy(*key).agg(F.min(place).alias("at"), F.max(place).alias("to")).where("at != to").select(*key, F.col("at.k").alias("k0"), F.col("at.th").alias("th0"), F.col("at.pos").alias("pos0")), "ends")
    out = rows.join(ends, key)
    if keep_first:
        out = out.where("not (k = k0 and th = th0 and pos = pos0)")
    return out.select("k", "th", "pos", F.col("n").cast("int").alias("n"))


def _by_text(docs: DataFrame, places: DataFrame, asked: list[str]) -> DataFrame:
    """``(k, th, text, asked)``: each document's bytes with the structs of ``places`` in it."""
    lists = places.groupBy("k", "th").agg(F.collect_list(F.struct(*asked)).alias("asked"))
    return _keyed(docs, [F.col("text").cast("binary").alias("text")]).join(lists, ["k", "th"]).select("k", "th", "text", "asked")


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


_LONG, _INT = pa.int64(), pa.int32()
_PIECE = {"key": _LONG, "c1": _LONG, "c2": _LONG, "k": _LONG, "th": _LONG, "pos": _LONG, "n": _INT, "base": _LONG}
_WINDOW = {"c1": _LONG, "c2": _LONG, "k": _LONG, "th": _LONG, "pos": _LONG, "n": _INT}
_STRETCH = {"key": _LONG, "k": _LONG, "th": _LONG, "pos": _LONG, "n": _INT, "rel": _INT, "raw": pa.binary()}


def _sql(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'long' if t == _LONG else 'int' if t == _INT else 'binary'}" for c, t in kinds.items())


def _hot_windows(hot: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeated windows of groups that are too large for a task, as ``(k, th, pos, n)``.

    ``hot`` has their stretches as in _STRETCH. Equal windows stand at the same place against the
    minimiser, so they lie in pieces of the same number there, whose windows all hold the same
    middle bytes. Pieces are merged by content; where several share a middle their windows are
    merged one by one. Rows are narrow and keys are aggregated map-side.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for core, k, th, pos, n, rel, raw in zip(*(c.to_pylist() for c in b.columns)):
                view = memoryview(raw)
                for s in range(rel // SUB, (rel + n - 1) // SUB + 1):
                    a, z = max(rel, s * SUB) - rel, min(rel + n, (s + 1) * SUB) - rel
                    held = view[(s + 1) * SUB - 1 - rel : s * SUB + length - rel]
                    head = (s & 0xFFFFFFFF).to_bytes(4, "little") + core.to_bytes(8, "little", signed=True)
                    key = _digest(head + held)[:8]
                    whole = _digest(head + (a + rel).to_bytes(4, "little", signed=True) + view[a : z + length - 1])
                    out.append((*(int.from_bytes(y, "little", signed=True) for y in (key, whole[:8], whole[8:])), k, th, pos + a, z - a, pos))
            yield _batch(out, _PIECE)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, th, base, raw, asked in zip(*(c.to_pylist() for c in b.columns)):
                view = memoryview(raw)
                for x in asked:
                    for p in range(x["pos"], x["pos"] + x["n"]):
                        d = _digest(view[p - base : p - base + length])
                        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), k, th, p, 1))
                if len(out) > 50_000:
                    yield _batch(out, _WINDOW)
                    out = []
            yield _batch(out, _WINDOW)

    cuts = cut(hot.mapInArrow(pieces, _sql(_PIECE)), "pieces")
    kinds = cut(cuts.groupBy("key", "c1", "c2").agg(F.min(F.struct("k", "th", "pos", "n", "base")).alias("at")).select("key", "c1", "c2", "at.*"), "piece-kinds")
    several = cut(kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "middles")
    open_ = kinds.join(several, "key").groupBy("k", "th", "base").agg(F.collect_list(F.struct("pos", "n")).alias("asked"))
    each = hot.select("k", "th", F.col("pos").alias("base"), "raw").join(open_, ["k", "th", "base"])
    each = cut(each.mapInArrow(windows, _sql(_WINDOW)), "windows")
    return _elsewhere(cuts, ["key", "c1", "c2"], keep_first).union(_elsewhere(each, ["c1", "c2"], keep_first))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot: int = HOT) -> DataFrame:
    """``(k, th, ranges)``: the windows of each document that occur elsewhere, as (pos, n) runs.

    ``keep_first``: only windows that also start earlier, in order of doc_id and place. Groups of
    over ``hot`` bytes are not brought together.
    """
    spark, gram = docs.sparkSession, min(GRAM, max(1, length // 2))
    bounded_batches(spark)
    text = F.col("text").cast("binary").alias("text")
    schema = "k long, th long, pos long, n int, rel int, core long, f1 long, f2 long"
    occ = cut(_keyed(docs, [text]).select("k", "th", "text").mapInArrow(lambda it: _file(it, length, gram), schema), "stretches")
    # most minimisers occur once: their stretches leave before anything wide is shuffled twice
    # (counts are tables of their own: a join of two plain shuffles can be split where one minimiser has many rows)
    cores = cut(occ.groupBy("core").agg(F.count("*").alias("total")).where("total > 1").select("core"), "cores")
    occ = cut(occ.join(cores, "core"), "again")
    kinds = occ.groupBy("core", "f1", "f2").agg(F.count("*").alias("copies"), F.min(F.struct("k", "th", "pos")).alias("at"), F.first("n").alias("n"), F.first("rel").alias("rel"))
    kinds = cut(kinds.select("core", "f1", "f2", "copies", "at.k", "at.th", "at.pos", "n", "rel"), "kinds")
    shared = cut(kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + F.lit(length - 1)).alias("bytes")).where("kinds > 1").select("core", (F.col("bytes") > hot).alias("hot")), "shared")

    # stretches that occur whole again
    whole = occ.join(kinds.where("copies > 1").select("core", "f1", "f2", F.col("k").alias("k0"), F.col("th").alias("th0"), F.col("pos").alias("pos0")), ["core", "f1", "f2"])
    if keep_first:
        whole = whole.where("not (k = k0 and th = th0 and pos = pos0)")
    found = whole.select("k", "th", "pos", F.col("n").cast("int").alias("n"))

    # others that share their minimiser: fetch the bytes, compare in suffix order
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, th, raw, asked in zip(*(c.to_pylist() for c in b.columns)):
                out += [(x["core"], k, th, x["pos"], x["n"], x["rel"], raw[x["pos"] : x["pos"] + x["n"] + length - 1]) for x in asked]
            yield _batch(out, _STRETCH)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list) -> pa.RecordBatch:
            found = _match([*{x[:3]: x for x in rows}.values()], length, keep_first)  # repeated rows came more than once
            return _batch(found, {"k": _LONG, "th": _LONG, "pos": _LONG, "n": _INT})

        rows: list = []
        held, last = 0, None
        for b in batches:
            for key, k, th, pos, n, _, raw in zip(*(c.to_pylist() for c in b.columns)):
                if held >= POOL and key != last:
                    yield give(rows)
                    rows, held = [], 0
                rows.append((k, th, pos, n, raw))
                held, last = held + len(raw), key
        if rows:
            yield give(rows)

    asked = kinds.join(shared, "core")
    fetched = lambda places: _by_text(docs, places, ["pos", "n", "rel", "core"]).mapInArrow(fetch, _sql(_STRETCH))
    pool = fetched(asked.where("not hot")).repartition("key").sortWithinPartitions("key")
    found = found.union(pool.mapInArrow(match, "k long, th long, pos long, n int"))
    if shared.where("hot").limit(1).count():
        found = found.union(_hot_windows(cut(fetched(asked.where("hot")), "hot"), length, keep_first))
    return found.groupBy("k", "th").agg(F.collect_set(F.struct("pos", "n")).alias("ranges"))


def remove_repeats(raw: bytes, ranges: list[dict] | None, length: int = LENGTH, chars: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the removed spans. ``chars``: only whole UTF-8 characters go."""
    spans: list[list[int]] = []
    for a, z in sorted((x["pos"], x["pos"] + x["n"] + length - 1) for x in ranges or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    if chars:
        for s in spans:
            while s[0] < s[1] and raw[s[0]] & 0xC0 == 0x80:
                s[0] += 1
            while s[1] > s[0] and s[1] < len(raw) and raw[s[1]] & 0xC0 == 0x80:
                s[1] -= 1
    spans = [s for s in spans if s[0] < s[1]]
    kept, at = [], 0
    for a, z in spans:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return b"".join(kept), [(a, z) for a, z in spans]


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, chars: bool = False, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere.

    ``keep_first`` keeps the earliest occurrence (by doc_id, then place) of each string and
    removes every byte of the later ones, so a string that overlaps its own copy keeps what
    stands before the copy. Returns the columns of ``docs`` and n_bytes, n_removed, n_spans,
    kept (binary). Null texts count as empty; matches never cross rows; repeated rows repeat
    each other and so lose what they share (with ``keep_first``, rows equal in doc_id and text
    count as one place). A null doc_id stands before all others. Columns of ``docs`` named as
    a result column are replaced. An empty table gives an empty result.
    """
    ranges = repeated_ranges(docs, length, keep_first, hot)
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    keyed = _keyed(docs, [F.struct(*own).alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")])
    rows = keyed.join(ranges, ["k", "th"], "left").select("row.*", F.col("raw").alias("__quadrille_raw"), F.col("ranges").alias("__quadrille_ranges"))
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, facts = [], [[], [], []]
            for raw, ranges in zip(b.column("__quadrille_raw").to_pylist(), b.column("__quadrille_ranges").to_pylist()):
                kept, spans = remove_repeats(raw, ranges, length, chars) if ranges else (raw, [])
                rest.append(kept)
                for f, v in zip(facts, (len(raw), len(raw) - len(kept), len(spans))):
                    f.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(f, pa.int64()) for f in facts), pa.array(rest, pa.binary())], names=[*own, "n_bytes", "n_removed", "n_spans", "kept"])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in own), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return rows.mapInArrow(run, schema)
