"""SimHash near-duplicate detection: exact Hamming links by tiled numpy comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.fingerprint import bin_minima
from quadrille.llm.suffix import _mix
from quadrille.operators.components import connected_components
from quadrille.session import bounded_batches, cut

__all__ = ["simhash", "fingerprints", "tile_links", "masks", "hamming_links", "near_duplicates", "shingle_set", "wide_print", "band_keys", "candidate_links", "similar_links", "similar_groups", "keep_one"]

BITS = 64
TILE = 64
BANDS, DEPTH, EARLY = 25, 5, 3
PIECE = 1 << 16
WORDS = 4
FIRST = 22
WIDE = 72


def simhash(text: str | bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text.

    A-Z are lowered, words are runs outside ASCII white space, shingles count as often as
    they occur and are joined by one space. Fewer words than ``width``: the whole sequence
    is the only shingle. None or no word: 0. A bit is set if it is set in over half of the
    shingles' XXH64.
    """
    raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= width:
        return h(b" ".join(words), seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    line, ends = b" ".join(words), ends.tolist()
    counts, m = np.zeros(BITS, np.int64), n - width + 1
    for k in range(0, m, PIECE):  # bounds the unpacked bits of a very long text
        t = min(m, k + PIECE)
        v = np.array([h(line[a:b], seed) for a, b in zip(starts[k:t], ends[k + width - 1 : t + width - 1])], dtype="<u8")
        counts += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > m).tolist()))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is the SimHash as a signed long. One pass, no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([simhash(x.as_py(), width, seed) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def tile_links(fp: np.ndarray, radius: int = 2, tile: int = TILE, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) among fingerprints that differ in at most ``radius`` bits and share their key.

    Fingerprints are ordered by key and population count and cut into tiles, which many small
    keys share. Two tiles are compared whole, by exclusive-or and bit count, unless no key
    reaches from one to the other or their population counts differ by more than the radius,
    which no linked pair's can. All pairs of tiles at one distance are compared together, a few
    megabytes at a time. Of what is found at a time only a spanning forest of the links is kept,
    so that dense groups give no more links than fingerprints. Without keys all share one.
    """
    n = len(fp)
    none = np.empty(0, fp.dtype)
    if n < 2:
        return none, none
    key = np.zeros(n, np.int64) if key is None else key
    pop = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((fp, pop, key))
    fp, pop, key = fp[order], pop[order], key[order]
    m = -(-n // tile)
    more = m * tile - n  # the last tile is filled up with a key of its own
    rows = np.append(fp, np.zeros(more, fp.dtype)).reshape(m, tile)
    keys = np.append(key, np.full(more, key[-1] + 1)).reshape(m, tile)
    first, last = np.arange(m) * tile, np.minimum(np.arange(1, m + 1) * tile, n) - 1
    out_a, out_b = [none], [none]
    upper = np.triu(np.ones((tile, tile), bool), 1)
    step = max(1, (1 << 20) // (tile * tile))
    for d in range(m):
        i = np.arange(m - d)
        if d:
            i = i[(key[last[: m - d]] == key[first[d:]]) & (pop[first[d:]] - pop[last[: m - d]] <= radius)]
            if not len(i):
                break  # tiles further apart meet even less
        for k in range(0, len(i), step):
            x = i[k : k + step]
            near = np.bitwise_count(rows[x][:, :, None] ^ rows[x + d][:, None, :]) <= radius
            near &= keys[x][:, :, None] == keys[x + d][:, None, :]
            if not d:
                near &= upper
            t, r, c = np.nonzero(near)
            a, b = x[t] * tile + r, (x[t] + d) * tile + c
            a, b = a[b < n], b[b < n]
            if len(a):
                nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
                a, b = forest(at[: len(a)], at[len(a) :], len(nodes))
                out_a.append(fp[nodes[a]])
                out_b.append(fp[nodes[b]])
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (least member, member) of the components that the pairs (rows, cols) make."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def masks(n: int, radius: int) -> list[int]:
    """Bit masks, one a table, such that two of ``n`` fingerprints within ``radius`` bits agree under one.

    The bits are cut into ``radius + intact`` blocks, of which such a pair has ``intact`` alike
    (Manku et al. 2007). More intact blocks make more tables with smaller buckets; the number
    is chosen by cost and changes no result. A row in a table costs about 3000 comparisons.
    """

    def cost(intact: int) -> float:
        blocks = radius + intact
        return comb(blocks, intact) * (3000 + n / 2 ** (BITS * intact // blocks) / 2)

    intact = min(range(1, 5), key=cost)
    cuts = [BITS * k // (radius + intact) for k in range(radius + intact + 1)]
    block = [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:])]
    return [sum(block[i] for i in kept) for kept in combinations(range(len(block)), intact)]


def hamming_links(fps: DataFrame, radius: int = 2, hot: int = 16384) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``fps(fp)`` within ``radius`` bits.

    What decides is the comparison of tiles in order of population count (:func:`tile_links`). So
    that not all tiles of a corpus meet, fingerprints are first dealt by what each of
    :func:`masks` leaves of them, a second index that loses no link. A bucket of over ``hot``
    fingerprints is dealt on by population count, counts of over ``hot`` by hash as well: only
    parts whose counts are within the radius meet, two parts a task, so no task gets more than
    about twice ``hot``. Nothing is capped; pairs are never listed.
    """
    bounded_batches(fps.sparkSession, rows=65536)
    f = fps.select("fp").distinct()
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(f.count(), radius)]
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)]))
    dealt = f.select("fp", band.alias("band")).selectExpr("fp", "band.k", "band.v")
    size = dealt.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(size, ["k", "v"])
    small = dealt.where(F.col("n") <= hot).selectExpr("k", "v", "-1 t1", "-1 t2", "fp")
    large = dealt.where(F.col("n") > hot).selectExpr("k", "v", "fp", "int(bit_count(fp)) pop")
    # parts of each population count of a large bucket: at most 65 entries
    counts = large.groupBy("k", "v", "pop").agg(F.count("*").alias("n")).groupBy("k", "v").agg(F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / hot).cast("int").alias("g")))).alias("parts"))
    large = large.join(counts, ["k", "v"]).selectExpr("k", "v", "fp", "pop", "parts", "pop * 1048576 + int(pmod(xxhash64(fp), parts[pop])) own")
    meets = f"""explode(flatten(transform(sequence(pop - {radius}, pop + {radius}), q ->
        transform(filter(sequence(0, coalesce(try_element_at(parts, q), 0)), x -> x < coalesce(try_element_at(parts, q), 0)),
                  x -> struct(least(own, q * 1048576 + x) as t1, greatest(own, q * 1048576 + x) as t2))))) m"""
    large = large.selectExpr("k", "v", "fp", meets).selectExpr("k", "v", "m.t1", "m.t2", "fp")
    key = ["k", "v", "t1", "t2"]
    rows = small.union(large).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
            a, b = tile_links(fp, radius, key=number)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key, fp = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for b in batches:
            key = np.concatenate((key, np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)))
            fp = np.concatenate((fp, b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)))
            last = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            if last:  # buckets that are over
                yield links(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(fp):
            yield links(key, fp)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links of ``radius`` bits.

    Takes ``doc_id`` and ``text``; other columns are ignored. Null, empty or blank texts have
    fingerprint 0 and link like any other. Repeated rows give repeated rows. A null doc_id
    keeps its row and is never a smallest id; a component of nulls only has component_id null.
    An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, width, seed), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(hamming_links(distinct, radius)).withColumnsRenamed({"node": "fp"})
    known = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(known.join(ids, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def shingle_set(text: str | bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of the shingles that :func:`simhash` takes, in order; empty without a word."""
    raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    words = raw.lower().split()
    n, h = len(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([h(b" ".join(words), seed)] if n else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    line, ends = b" ".join(words), ends.tolist()
    parts, m = [], n - width + 1
    for k in range(0, m, PIECE):
        t = min(m, k + PIECE)
        parts.append(np.unique(np.array([h(line[a:b], seed) for a, b in zip(starts[k:t], ends[k + width - 1 : t + width - 1])], dtype=np.uint64)))
    return np.unique(np.concatenate(parts))


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set in ``WORDS`` words of 64 bits; the first takes the hashes as they are."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        counts = np.zeros(BITS, np.int64)
        for k in range(0, len(shingles), PIECE):
            x = shingles[k : k + PIECE]
            if w:  # mixed anew, after splitmix64
                x = x + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << BITS))
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                x = x ^ x >> np.uint64(31)
            bits = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0]
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys (32 bits) of a sorted, non-empty shingle set: each of DEPTH values of its one-permutation MinHash.

    Two sets of similarity s have a given key in common with probability s^DEPTH, so that at 0.8
    they share none with a probability of (1 - 0.8^5)^25, 5 in 100,000.
    """
    v = bin_minima(shingles)[: BANDS * DEPTH].reshape(BANDS, DEPTH)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(DEPTH):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
    return key.astype(np.uint32)


def candidate_links(key: np.ndarray, root: np.ndarray, n: np.ndarray, w: np.ndarray, least: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the roots of pairs of one key that may have a similarity of ``least``.

    ``root`` names the group of candidates that a set belongs to so far, itself if to none.

    Sets are ordered by key and size and compared tile by tile, as in :func:`tile_links`, but for
    tiles whose sizes rule the similarity out: the first words of their SimHashes may differ in
    ``FIRST`` bits, all words in ``WIDE``. Sets of a similarity of 0.8 differ in 48 of 256 bits at most
    in the mean.
    """
    none = np.empty(0, np.int64)
    if len(key) < 2:
        return none, none
    order = np.lexsort((n, key))
    key, root, n, w = key[order], root[order], n[order], w[order]
    size, m = len(key), -(-len(key) // tile)
    more = m * tile - size
    rows = np.append(w[:, 0], np.zeros(more, np.uint64)).reshape(m, tile)
    number = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    keys = np.append(number, np.zeros(more, np.int64)).reshape(m, tile)
    first, last = np.arange(m) * tile, np.minimum(np.arange(1, m + 1) * tile, size) - 1
    out_a, out_b = [none], [none]
    upper = np.triu(np.ones((tile, tile), bool), 1)
    step = max(1, (1 << 20) // (tile * tile))
    for d in range(m):
        i = np.arange(m - d)
        if d:
            i = i[(key[last[: m - d]] == key[first[d:]]) & (n[first[d:]] * least <= n[last[: m - d]] + 1e-6)]
            if not len(i):
                break
        for k in range(0, len(i), step):
            x = i[k : k + step]
            near = np.bitwise_count(rows[x][:, :, None] ^ rows[x + d][:, None, :]) <= FIRST
            near &= keys[x][:, :, None] == keys[x + d][:, None, :]
            if not d:
                near &= upper
            t, r, c = np.nonzero(near)
            a, b = x[t] * tile + r, (x[t] + d) * tile + c
            a, b = a[b < size], b[b < size]
            ok = (n[b] * least <= n[a] + 1e-6) & (root[a] != root[b])
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(w[a] ^ w[b]).sum(axis=1, dtype=np.int64) <= WIDE
            if ok.any():
                nodes, at = np.unique(np.concatenate((root[a[ok]], root[b[ok]])), return_inverse=True)
                a, b = forest(at[: ok.sum()], at[ok.sum() :], len(nodes))
                out_a.append(nodes[a])
                out_b.append(nodes[b])
    return np.concatenate(out_a), np.concatenate(out_b)


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning links of the pairs of non-empty ``sets`` with a Jaccard similarity of ``least`` or more, all counted out."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    s = [sets[i] for i in order]
    size, label, out = np.array([len(x) for x in s]), np.arange(len(s)), []
    for i in range(len(s) - 1):
        j = np.flatnonzero((label[i + 1 :] != label[i]) & (size[i + 1 :] * least <= size[i] + 1e-6)) + i + 1
        if not len(j):
            continue
        every = np.concatenate([s[x] for x in j])
        hit = s[i][np.minimum(np.searchsorted(s[i], every), size[i] - 1)] == every
        both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size[j])[:-1])))
        for x in j[both >= least * (size[i] + size[j] - both) - 1e-6].tolist():
            if label[x] != label[i]:
                out.append((order[i], order[x]))
                label[label == label[x]] = label[i]
    return out


def similar_groups(docs: DataFrame, width: int = 5, least: float = 0.8, seed: int = 42, tile: int = 16384, chunk: int = 512) -> DataFrame:
    """``(doc_id, component_id)``: the smallest doc_id reachable over links of exact similarity ``least``.

    Sets meet that share one of :func:`band_keys`, a second index; of those that do, candidates are
    the pairs that :func:`candidate_links` finds by comparing 256-bit SimHashes in tiles. Keys of
    over ``tile`` sets are dealt to parts of that size by hash, of which a task gets two. Of each group of
    candidates the sets themselves are then compared, ``chunk`` by ``chunk`` in a large group, and
    only pairs with a Jaccard similarity of ``least`` link. Nothing is capped. Equal sets link.
    Null and blank texts have the empty set and link to each other. Nulls as in :func:`near_duplicates`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = [f"w{w}" for w in range(WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), width, seed) for x in b.column(2)]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            w = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            bands = pa.array([band_keys(s).view(np.int32) if len(s) else [] for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (key, n)), *(pa.array(np.ascontiguousarray(w[:, i])) for i in range(WORDS)), bands], names=["doc_id", "h", "k", "n", *words, "bands"])

    raw = F.col("text").cast("binary")
    rows = docs.select("doc_id", F.xxhash64(raw).alias("h"), raw.alias("raw"))
    sketches = cut(rows.mapInArrow(sketch, f"doc_id {kind}, h long, k long, n long, {', '.join(f'{w} long' for w in words)}, bands array<int>"), "sketches")

    nodes = sketches.where("n > 0").dropDuplicates(["k"]).select("k", "n", *words, "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            number = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
            a, b = candidate_links(number, x[:, 0], x[:, 1], x[:, 2:].view(np.uint64), least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = np.empty((0, 5 + WORDS), np.int64)
        for b in batches:
            held = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)))
            over = (held[:, :3] != held[-1, :3]).any(axis=1) if len(held) else np.zeros(0, bool)
            last = int(np.flatnonzero(over)[-1]) + 1 if over.any() else 0
            if last:
                yield links(held[:last, :3], np.ascontiguousarray(held[:last, 3:]))
                held = held[last:]
        if len(held):
            yield links(held[:, :3], np.ascontiguousarray(held[:, 3:]))

    def links(bands: Column, roots: DataFrame | None) -> DataFrame:
        met = nodes.select("k", F.explode(bands).alias("band"))
        met = met.withColumn("root", F.col("k")) if roots is None else met.join(roots, F.col("k") == F.col("node"), "left").select("k", "band", F.coalesce("root", "k").alias("root"))
        # most keys are of one set or one group; the others' rows are counted and go on, by a sort that spills
        w = Window.partitionBy("band")
        met = met.select("*", F.count("*").over(w).alias("c"), F.min("root").over(w).alias("r0"), F.max("root").over(w).alias("r1")).where("r0 < r1").drop("r0", "r1")
        met = met.join(nodes.drop("bands"), "k").withColumn("own", F.ceil(F.col("c") / tile).cast("int")).withColumn("g", F.pmod(F.xxhash64("k"), F.col("own")).cast("int"))
        meets = F.expr("explode(transform(filter(sequence(0, own), x -> x < own), x -> struct(least(g, x) as g1, greatest(g, x) as g2)))")
        dealt = met.select("band", meets.alias("m"), "root", "n", *words).select("band", "m.g1", "m.g2", "root", "n", *words)
        return dealt.repartition("band", "g1", "g2").sortWithinPartitions("band", "g1", "g2").mapInArrow(compare, "a long, b long")

    # copies mostly meet under one of the first keys; under the others only their groups still have to
    early = cut(connected_components(links(F.slice("bands", 1, EARLY), None)), "early")
    late = links(F.slice("bands", EARLY + 1, BANDS - EARLY), early)
    found = connected_components(early.selectExpr("node a", "root b").union(late))
    member = sketches.select("k", "n", "h").join(found, F.col("k") == F.col("node")).groupBy("k", "n", "root").agg(F.min("h").alias("h"))
    member = cut(member, "candidates")
    whole = member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / (chunk * 400))).cast("int").alias("own"))
    member = member.join(whole, "root").select("h", "k", "root", "own")
    texts = rows.select("h", "raw").join(member, "h").groupBy("k", "root", "own").agg(F.first("raw").alias("raw"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(x.as_py(), width, seed).tobytes() for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sets], names=["k", "root", "own", "s"])

    sets = texts.mapInArrow(hashed, "k long, root long, own int, s binary").withColumn("g", F.pmod(F.xxhash64("k"), F.col("own")).cast("int"))
    pairs = F.expr("explode(transform(filter(sequence(0, own), x -> x < own), x -> struct(least(g, x) as g1, greatest(g, x) as g2)))")
    sets = sets.select("k", "root", "s", pairs.alias("m")).select("root", "m.g1", "m.g2", "k", "s").repartition("root", "g1", "g2").sortWithinPartitions("root", "g1", "g2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[pa.RecordBatch]:
            got = similar_links(group, least)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([names[x[i]] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        last, names, group = None, [], []
        for b in batches:
            for *key, k, s in zip(*(c.to_pylist() for c in b.columns)):
                if key != last:
                    yield from links()
                    last, names, group = key, [], []
                names.append(k)
                group.append(np.frombuffer(s, np.uint64))
        yield from links()

    roots = connected_components(sets.mapInArrow(verify, "a long, b long")).withColumnsRenamed({"node": "k"})
    known = sketches.select("doc_id", "k").join(roots, "k", "left").select("doc_id", F.coalesce("root", "k").alias("root"))
    ids = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return known.join(ids, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group.

    Groups are those of :func:`near_duplicates` or, where ``least`` is given, of :func:`similar_groups`. Rows without an id stay only where no row of
    their group has one; all rows that share an id that stays do. The result has the columns
    of ``docs``.
    """
    groups = near_duplicates(docs, width, radius, seed) if least is None else similar_groups(docs, width, least, seed)
    stay = groups.where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("__quadrille_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__quadrille_id")), "left_semi")
