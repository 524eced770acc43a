"""Morphological segmentation of binary maps: core, edge, perforation, islet, connectors, openings.

A raster becomes tiles of 16-bit flags on a grid with a frame round it. Distances are only ever
compared with the edge width, so they are dilations by a fixed disc (a halo exchange); what
depends on the whole map is reachability (:func:`quadrille.operators.regions.reach`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.checks import check_mspa, check_spa
from quadrille.operators import skeleton as sk
from quadrille.operators.regions import reach, regions
from quadrille.operators.tiles import ABSENT, TILE, TILE_SCHEMA, cut_tiles, in_tiles, map_tiles, over_tiles, to_tiles
from quadrille.session import cut

__all__ = ["disc", "dilate", "spa", "mspa", "connectors", "thin"]

#: Flags of a cell. The two lowest bits are the input: 0 missing, 1 background, 2 foreground.
PRESENT, FG, CORE, A, B, C, D, E, G, H, K = (1 << i for i in range(2, 13))
U16 = np.uint16


def disc(edge: int) -> list[tuple[int, int]]:
    """Offsets whose distance is at most ``edge + 0.98``, by integers."""
    return [(i, j) for i in range(-edge - 1, edge + 2) for j in range(-edge - 1, edge + 2) if (i * i + j * j) * 10_000 <= (100 * edge + 98) ** 2]


def dilate(mask: np.ndarray, edge: int) -> np.ndarray:
    """Cells within the disc of a cell of the mask: per row offset, one running count."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    for i in range(-edge - 1, edge + 2):
        span = max((j for a, j in disc(edge) if a == i), default=-1)
        if span < 0:
            continue
        s = np.concatenate((np.zeros((h, 1), np.int32), np.cumsum(mask, axis=1, dtype=np.int32)), axis=1)
        near = s[:, np.minimum(np.arange(w) + span + 1, w)] > s[:, np.maximum(np.arange(w) - span, 0)]
        out[max(0, -i) : h - max(0, i)] |= near[max(0, i) : h - max(0, -i)]
    return out


@dataclass(frozen=True)
class Frame:
    """Rows and columns of the map with its frame; ``ring`` marks the outermost cells."""

    r0: int
    c0: int
    r1: int
    c1: int

    def ring(self, a: np.ndarray, r0: int, c0: int) -> np.ndarray:
        r, c = np.arange(r0, r0 + a.shape[0])[:, None], np.arange(c0, c0 + a.shape[1])[None, :]
        inside = (r >= self.r0) & (r <= self.r1) & (c >= self.c0) & (c <= self.c1)
        return inside & ((r == self.r0) | (r == self.r1) | (c == self.c0) | (c == self.c1))


def _framed(cells: DataFrame, pad: int, tile: int) -> tuple[DataFrame, Frame] | None:
    """Tiles of flags over the map's bounding box and a frame of ``pad`` missing cells."""
    if in_tiles(cells):
        box = _box(cells)
    else:
        box = cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    if box[0] is None:
        return None
    # tiles are whole, so the frame goes on to their edge
    r0, c0 = (box[0] - pad) // tile * tile, (box[1] - pad) // tile * tile
    r1, c1 = -(-(box[2] + pad + 1) // tile) * tile - 1, -(-(box[3] + pad + 1) // tile) * tile - 1
    down, across = (r1 - r0 + 1) // tile, (c1 - c0 + 1) // tile
    spark = cells.sparkSession
    grid = spark.range(down * across).select((F.col("id") / across).cast("long").cast("int").alias("i"), (F.col("id") % across).cast("int").alias("j"))
    grid = grid.select((F.col("i") + r0 // tile).alias("tr"), (F.col("j") + c0 // tile).alias("tc"))
    own = (cells if in_tiles(cells) else to_tiles(cells.where(F.col("v").isNotNull()), tile)).select("tr", "tc", "data")
    rows = grid.join(own, ["tr", "tc"], "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, tr, tc = [], b.column("tr").to_pylist(), b.column("tc").to_pylist()
            for data in b.column("data").to_pylist():
                a = np.full((tile, tile), ABSENT, np.uint8) if data is None else np.frombuffer(data, np.uint8).reshape(tile, tile)
                out.append(np.where(a == ABSENT, 0, (a & 3) | np.where(a < 8, PRESENT, 0)).astype(U16).tobytes())
            n = len(tr)
            ints = [pa.array(x, pa.int32()) for x in (tr, tc, [t * tile for t in tr], [t * tile for t in tc], [tile] * n, [tile] * n)]
            yield pa.RecordBatch.from_arrays([*ints, pa.array(out, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    return over_tiles(rows, fill, TILE_SCHEMA), Frame(r0, c0, r1, c1)


def _box(tiles: DataFrame) -> tuple:
    """First row and column, last row and column of the cells that tiles have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r0, c0, h, w, data in zip(*(b.column(c).to_pylist() for c in ("r0", "c0", "h", "w", "data"))):
                there = np.frombuffer(data, np.uint8).reshape(h, w) != ABSENT
                r, c = np.flatnonzero(there.any(axis=1)), np.flatnonzero(there.any(axis=0))
                if len(r):
                    out.append((r0 + r[0], c0 + c[0], r0 + r[-1], c0 + c[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32()) for i in range(4)], names=["a", "b", "c", "d"])

    found = over_tiles(tiles.select("r0", "c0", "h", "w", "data"), find, "a int, b int, c int, d int")
    return found.agg(F.min("a"), F.min("b"), F.max("c"), F.max("d")).first()


def _code_tiles(tiles: DataFrame) -> DataFrame:
    """As :func:`_codes`, in tiles of bytes; tiles without a cell go."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, U16) for x in b.column("data").to_pylist()]
            has = pa.array([bool((a >> 15).any()) for a in own])
            data = pa.array([np.where(a >> 15, a & 255, ABSENT).astype(np.uint8).tobytes() for a in own], pa.binary())
            names = ["tr", "tc", "r0", "c0", "h", "w"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), data], names=[*names, "data"]).filter(has)

    return over_tiles(tiles, pack, TILE_SCHEMA)


def _codes(tiles: DataFrame) -> DataFrame:
    """Cells of flag tiles whose value (low byte) is a code and whose PRESENT bit, moved to bit 15, is set."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, c0, h, w, data in zip(*(b.column(c).to_pylist() for c in ("r0", "c0", "h", "w", "data"))):
                a = np.frombuffer(data, U16).reshape(h, w)
                i, j = np.nonzero(a >> 15)
                yield pa.RecordBatch.from_arrays([pa.array((i + r0).astype(np.int32)), pa.array((j + c0).astype(np.int32)), pa.array((a[i, j] & 255).astype(np.int16))], names=["row", "col", "v"])

    return over_tiles(tiles, unpack, "row int, col int, v short")


def _flag(a: np.ndarray, bit: int, on: np.ndarray) -> np.ndarray:
    return np.where(on, a | bit, a & ~U16(bit))


def _heal_and_core(edge: int):
    """Missing cells near foreground count as foreground; core is farther than the edge from any other cell."""

    def run(a: np.ndarray) -> np.ndarray:
        fg = (a & 3) == 2
        fg = fg | (((a & 3) == 0) & dilate(fg, edge))
        core = fg & ~dilate(~fg, edge)
        m = 2 * (edge + 1)
        return _flag(_flag(a, FG, fg), CORE, core)[m:-m, m:-m]

    return run


def spa(cells: DataFrame, edge: int, classes: int = 6, tile: int = TILE) -> DataFrame:
    """Simplified segmentation of a binary map (0 missing, 1 background, 2 foreground).

    Codes: 17 core, 3 edge, 5 perforation, 9 islet, 1 margin, 100 core opening, 0 background,
    129 missing. With 5 classes islets are margins; with 3 edges and perforations are too; with 2
    core and its rim are 17, all other foreground 1, and openings background. Returns
    ``row, col, v`` of the cells that the map has, or of a map in tiles (of one size) tiles. An
    empty map gives an empty result.
    """
    check_spa(edge, classes)
    if in_tiles(cells) and (one := cells.select("h").first()):
        tile = one[0]
    framed = _framed(cells, 2 * edge + 4, tile)
    if framed is None:
        return cells if in_tiles(cells) else cells.select("row", "col", F.lit(0).cast("short").alias("v"))
    tiles, frame = framed
    on = lambda bit: lambda a: (a & bit) != 0
    off = lambda bit: lambda a: (a & bit) == 0
    seeds = lambda bit: lambda a, r, c: (a & bit) != 0
    mark = lambda bit: lambda a, hit: _flag(a, bit, hit)
    tiles = map_tiles(tiles, _heal_and_core(edge), 2 * (edge + 1), U16, 0)
    tiles = reach(tiles, on(FG), seeds(CORE), mark(A), 8, U16)  # A: foreground joined to a core
    tiles = reach(tiles, off(FG), frame.ring, mark(B), 8, U16)  # B: outer background
    tiles = reach(tiles, off(CORE), frame.ring, mark(C), 4, U16)  # C: outside every core

    def openings(a: np.ndarray) -> np.ndarray:
        hole = (a & (FG | B | C)) == 0
        m = edge + 1
        return _flag(_flag(a, D, hole), E, dilate(hole, edge))[m:-m, m:-m]  # D: core opening, E: near one

    tiles = cut_tiles(map_tiles(tiles, openings, edge + 1, U16, FG | B | C))
    tiles = reach(tiles, off(E), frame.ring, mark(G), 8, U16)  # G: outside the openings' surroundings

    def assemble(a: np.ndarray) -> np.ndarray:
        core, fg = (a & CORE) != 0, (a & FG) != 0
        inner = dilate(core & ((a & G) == 0), edge)
        halo = dilate(core, edge)
        many = classes > 2
        perforation = ((a & E) != 0) & ~inner
        code = np.select(
            [(a & 3) == 0, ((a & D) != 0) & many, ~fg, core, halo & (not many), (a & A) == 0, halo & perforation & many, halo & many],
            [129, 100, 0, 17, 17, 9 if classes == 6 else 1, 5 if classes >= 5 else 1, 3 if classes >= 5 else 1],
            1,
        )
        m = edge + 1
        return (code | ((a & PRESENT) << 13)).astype(U16)[m:-m, m:-m]

    return (_code_tiles if in_tiles(cells) else _codes)(map_tiles(tiles, assemble, edge + 1, U16, FG | G))


# MSPA -------------------------------------------------------------------------------------

#: Added to the code of a foreground cell that is part of a connector; 100 is added inside holes of cores.
BRIDGE, LOOP = 32, 64
#: Cells of one region that a task finishes; larger ones are thinned on in tiles.
LIMIT = 2_000_000
#: Cells of small regions that a task finishes together; a region of more is a task's alone.
SHARE = 250_000
#: Bits of a tile of skeleton cells; the low byte is the code of the core cells round a cell.
LINE, TRIED = 1 << 8, 1 << 9


def _replicated(cells: DataFrame, pad: int) -> DataFrame:
    """Cells and, round their bounding box, copies of its outermost ones (8 added to the value)."""
    box = cells.agg(F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d"))
    x = cells.crossJoin(F.broadcast(box))  # one row
    spread = lambda c, lo, hi: F.sequence(F.when(F.col(c) == F.col(lo), F.col(c) - pad).otherwise(F.col(c)), F.when(F.col(c) == F.col(hi), F.col(c) + pad).otherwise(F.col(c)))
    rim = x.where("row = a or row = c or col = b or col = d").withColumn("r", F.explode(spread("row", "a", "c"))).withColumn("k", F.explode(spread("col", "b", "d"))).where("not (r = row and k = col)")
    return cells.unionByName(rim.select(F.col("r").alias("row"), F.col("k").alias("col"), (F.col("v") + 8).cast("short").alias("v")))


def thin(mask: np.ndarray, anchor: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """What is left of ``mask`` when cells that don't connect anything are peeled off.

    A cell goes if its neighbours in mask and anchor are joined without it (it is simple); cells
    are tried in rings from outside in, each ring in row order, until none goes. Anchors stay
    and count as neighbours. Ends that no anchor holds are peeled back wholly.
    """
    m = np.pad(mask, 1)
    fixed = np.pad(anchor, 1)
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]

    def simple(r: int, c: int) -> bool:
        on = [bool(m[r + i, c + j] or fixed[r + i, c + j]) for i, j in around]
        if connectivity == 8:  # one background part touches by an edge: Hilditch's crossing number is 1
            return not all(on[1::2]) and sum(not on[k] and (on[(k + 1) % 8] or on[(k + 2) % 8]) for k in (1, 3, 5, 7)) == 1
        return sum(on[k] and not (on[(k + 1) % 8] and on[(k + 2) % 8]) for k in (1, 3, 5, 7)) == 1

    changed = True
    while changed:
        changed = False
        both = m | fixed
        inner = both[:-2, 1:-1] & both[2:, 1:-1] & both[1:-1, :-2] & both[1:-1, 2:]
        for r, c in zip(*np.nonzero(m[1:-1, 1:-1] & ~inner)):
            if simple(r + 1, c + 1):
                m[r + 1, c + 1] = False
                changed = True
    return m[1:-1, 1:-1]


def mspa(cells: DataFrame, connectivity: int = 8, edge: int = 1, intext: bool = True, tile: int = TILE) -> DataFrame:
    """Morphological spatial pattern analysis of a binary map (0 missing, 1 background, 2 foreground).

    Codes: 17 core, 3 edge, 5 perforation, 9 islet, 1 branch, 33 bridge, 65 loop, 0 background,
    129 missing; where a connector runs through an edge or a perforation to its core 35, 37 (bridge),
    67, 69 (loop). With ``intext`` 100 is added inside holes of cores (100 itself: core opening)
    and other holes of the foreground are 220. Core, islet, edge, perforation and openings
    follow from distances and nesting alone; connectors are :func:`connectors`. Returns
    ``row, col, v``.
    """
    check_mspa(connectivity, edge)
    fgc, bgc = connectivity, 12 - connectivity
    pad = 3 * (edge + 2)

    def heal(a: np.ndarray) -> np.ndarray:
        m = edge + 1
        return np.where((a == 0) & dilate(a == 2, edge), 3, a)[m:-m, m:-m]

    from quadrille.operators.tiles import from_tiles

    healed = from_tiles(map_tiles(to_tiles(cells.where(F.col("v").isNotNull()), tile), heal, edge + 1))
    framed = _framed(_replicated(healed, pad), edge + 4, tile)
    if framed is None:
        return cells.select("row", "col", F.lit(0).cast("short").alias("v"))
    tiles, frame = framed
    ISLET, DONE, LOW, HIGH, SEED, EDGE, PERF, OUT1 = A, B, C, D, E, G, H, K
    DEPTH = LOW | HIGH
    on = lambda bit: lambda a: (a & bit) != 0
    off = lambda bit: lambda a: (a & bit) == 0
    seeded = lambda bit: lambda a, r, c: (a & bit) != 0

    def cores(a: np.ndarray) -> np.ndarray:
        fg = (a & 3) >= 2
        here = (a & PRESENT) != 0
        own = ((a & 3) == 2) & here
        data = here & (((a & 3) == 1) | own)
        one = own | (~data & _grown(own, 8))  # missing cells, and those outside the map, beside foreground close holes
        m = edge + 1
        out = _flag(_flag(a, FG, fg), CORE, fg & ~dilate(~fg, edge))
        return _flag(out, OUT1, ~one)[m:-m, m:-m]  # for now: not foreground for openings

    tiles = map_tiles(tiles, cores, edge + 1, U16, 0)
    # OUT1 becomes: outside all holes of the foreground, or foreground
    tiles = reach(tiles, on(OUT1), frame.ring, lambda a, hit: _flag(a, OUT1, hit | ((a & OUT1) == 0)), bgc, U16)
    tiles = reach(tiles, on(FG), seeded(CORE), lambda a, hit: _flag(a, ISLET, ((a & FG) != 0) & ~hit), fgc, U16)

    # nesting: 0 outside, then cores and their holes in turn; kept modulo 4
    def settle(d: int):
        bits = U16((LOW if d & 1 else 0) | (HIGH if d & 2 else 0))
        return lambda a, hit: np.where(hit & ((a & DONE) == 0), a | DONE | bits, a)

    def seed(core: bool):
        def run(a: np.ndarray) -> np.ndarray:
            is_core, done = (a & CORE) != 0, (a & DONE) != 0
            other = done & (is_core != core)
            near = np.zeros_like(other)
            near[1:-1, 1:-1] = other[:-2, 1:-1] | other[2:, 1:-1] | other[1:-1, :-2] | other[1:-1, 2:]
            return _flag(a, SEED, (is_core == core) & ~done & near)[1:-1, 1:-1]

        return run

    tiles = reach(tiles, off(CORE), frame.ring, settle(0), bgc, U16)
    d = 0
    while _any(tiles, lambda a: (a & DONE) == 0):
        d += 1
        tiles = reach(map_tiles(tiles, seed(True), 1, U16, DONE), on(CORE), seeded(SEED), settle(d), fgc, U16)
        if _any(tiles, lambda a: (a & DONE) == 0):
            tiles = reach(map_tiles(tiles, seed(False), 1, U16, DONE | CORE), off(CORE), seeded(SEED), settle(d), bgc, U16)

    def rims(a: np.ndarray) -> np.ndarray:
        core, depth = (a & CORE) != 0, (a & DEPTH) // LOW
        halo = dilate(core, edge) & ~core & ((a & FG) != 0)
        outer = np.zeros_like(core)
        for k in range(4):  # a core one level deeper than where the cell lies is seen from outside
            outer |= (depth == k) & dilate(core & (depth == (k + 1) % 4), edge)
        m = edge + 1
        return _flag(_flag(a, EDGE, halo & outer), PERF, halo & ~outer)[m:-m, m:-m]

    tiles = cut_tiles(map_tiles(tiles, rims, edge + 1, U16, DONE))
    classes = connectors(tiles, lambda a: ((a & FG) != 0) & ((a & (CORE | ISLET)) == 0), lambda a: (a & CORE) != 0, edge, fgc, tile)

    def code(a: np.ndarray) -> np.ndarray:
        fg = (a & FG) != 0
        c = np.select([(a & CORE) != 0, (a & ISLET) != 0, (a & EDGE) != 0, (a & PERF) != 0, fg], [17, 9, 3, 5, 1], 0)
        if intext:
            inside = (a & SEED) != 0
            c = np.where(inside, c + 100, c)
            c = np.where(((a & OUT1) == 0) & ~(inside & ((a & CORE) == 0)), 220, c)
        return np.where((a & 3) % 3 == 0, 129, c) | ((a & PRESENT) << 13)

    # SEED anew: inside a hole of a core. Outside are what the ring reaches past cores, and cores beside it
    tiles = reach(tiles, off(CORE), frame.ring, lambda a, hit: _flag(a, SEED, ~hit & ((a & CORE) == 0)), bgc, U16)
    tiles = map_tiles(tiles, _outer_cores, 1, U16, 0)
    tiles = reach(tiles, on(CORE), seeded(DONE), lambda a, hit: _flag(a, SEED, (((a & CORE) == 0) & ((a & SEED) != 0)) | (((a & CORE) != 0) & ~hit)), fgc, U16)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [code(np.frombuffer(x, U16)).astype(U16).tobytes() for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w")), pa.array(out, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    plain = _codes(over_tiles(tiles, finish, TILE_SCHEMA))
    if classes is None:
        return plain
    return plain.join(classes, ["row", "col"], "left").select("row", "col", (F.col("v") + F.when(F.col("v") != 129, F.coalesce("k", F.lit(0))).otherwise(0)).cast("short").alias("v"))


def _outer_cores(a: np.ndarray) -> np.ndarray:
    core = (a & CORE) != 0
    out = ~core & ((a & E) == 0)  # outside every core
    near = np.zeros_like(out)
    near[1:-1, 1:-1] = out[:-2, 1:-1] | out[2:, 1:-1] | out[1:-1, :-2] | out[1:-1, 2:]
    return _flag(a, B, core & near)[1:-1, 1:-1]


def _any(tiles: DataFrame, test) -> bool:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = any(bool(test(np.frombuffer(x, U16)).any()) for x in b.column("data").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([hit])], names=["hit"])

    return bool(over_tiles(tiles.select("data"), run, "hit boolean").agg(F.max("hit")).first()[0])


def _grown(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """The mask and the cells beside it."""
    h, w = mask.shape
    p, out = np.pad(mask, 1), mask.copy()
    for i, j in sk.AROUND:
        if connectivity == 8 or i * j == 0:
            out |= p[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    return out


def _line_tile(a: np.ndarray, connectivity: int, rounds: int) -> np.ndarray:
    """A tile of skeleton cells after some rounds; what lies near its border is wrong afterwards."""
    r, c, link = sk.links_dense((a & LINE) != 0)
    v = a[r, c]
    on, tried = sk.peel(v & 255, link, np.ones(len(r), bool), (v & TRIED) != 0, connectivity, rounds)
    out = a & ~U16(LINE | TRIED)
    out[r, c] |= (on * LINE | tried * TRIED).astype(U16)
    return out


def _cells_of(found, active: DataFrame, test, value) -> DataFrame:
    """``row, col, region, x`` of the cells of some regions (``region``), and of ``test``; x is ``value`` of the flags."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tr, tc, r0, c0, h, w, data, labels in zip(*(b.column(c).to_pylist() for c in ("tr", "tc", "r0", "c0", "h", "w", "data", "labels"))):
                a, lab = np.frombuffer(data, U16).reshape(h, w), np.frombuffer(labels, np.int32).reshape(h, w)
                i, j = np.nonzero((lab > 0) & test(a))
                n = len(i)
                cols = (np.full(n, tr), np.full(n, tc), i + r0, j + c0, lab[i, j], value(a)[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in cols], names=["tr", "tc", "row", "col", "label", "x"])

    rows = over_tiles(found.tiles, unpack, "tr int, tc int, row int, col int, label int, x int")
    parts = found.parts if active is None else found.parts.join(active, "region")
    return rows.join(parts.select("tr", "tc", "label", "region"), ["tr", "tc", "label"]).select("row", "col", "region", "x")


def _with_cells(tiles: DataFrame, cells: DataFrame, tile: int, write) -> DataFrame:
    """New tiles: ``write(data, mask)`` is told which cells ``cells(row, col)`` has."""
    marked = to_tiles(cells.select("row", "col", F.lit(1).alias("v")), tile).select("tr", "tc", F.col("data").alias("mark"))
    rows = tiles.join(marked, ["tr", "tc"], "left").select("tr", "tc", "r0", "c0", "h", "w", "data", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, data, mark in zip(*(b.column(c).to_pylist() for c in ("h", "w", "data", "mark"))):
                m = np.zeros((h, w), bool) if mark is None else np.frombuffer(mark, np.uint8).reshape(h, w) != ABSENT
                out.append(write(np.frombuffer(data, U16).reshape(h, w), m).astype(U16).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w")), pa.array(out, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    return over_tiles(rows, run, TILE_SCHEMA)


def _skeleton(tiles: DataFrame, mask, core, edge: int, connectivity: int, tile: int, limit: int) -> DataFrame:
    """Tiles with LINE where the thinned mask is, thinned towards the cores, which stay.

    Rims of cores and the thick parts go in a few rounds in tiles, with a halo of two cells a
    round. What is then left unsettled is narrow: each of its regions is finished in a task, many
    small ones together; regions of over ``limit`` cells go on in tiles.
    """
    rounds = min(edge + 6, (tile - 3) // 2)

    def first(a: np.ndarray) -> np.ndarray:
        on, fixed = mask(a), np.pad(core(a), 1)
        h, w = a.shape
        near = np.zeros(a.shape, U16)
        for k, (i, j) in enumerate(sk.AROUND):
            near |= fixed[1 + i : 1 + i + h, 1 + j : 1 + j + w].astype(U16) << U16(k)
        m = 2 * rounds + 3
        return _line_tile(np.where(on, near | LINE | TRIED, 0).astype(U16), connectivity, rounds)[m:-m, m:-m]

    line = cut_tiles(map_tiles(tiles, first, 2 * rounds + 3, U16, 0), "line")
    waits = lambda a: (a & TRIED) != 0
    more = min(64, (tile - 3) // 2)
    while _any(line, waits):
        found = regions(line, lambda a: (a & LINE) != 0, 8, lambda a, r, c: (a & TRIED) != 0, U16)
        active = cut(found.parts.groupBy("region").agg(F.sum("n").alias("size"), F.max("seed").alias("open")).where("open").select("region", "size"), "active")
        total, most = active.agg(F.sum("size"), F.max("size")).first()
        if most > limit:
            m = 2 * more + 3
            line = cut_tiles(map_tiles(line, lambda a: _line_tile(a, connectivity, more)[m:-m, m:-m], m, U16, 0), "line")
            continue
        share = F.pmod(F.xxhash64("region"), F.lit(-(-total // SHARE))).alias("share")
        alone = active.where(F.col("size") > SHARE).select("region", F.col("region").alias("alone"))
        cells = _cells_of(found, active.select("region"), lambda a: np.ones(a.shape, bool), lambda a: a)
        cells = cells.join(F.broadcast(alone), "region", "left").select(share, "alone", "row", "col", "x")

        def finish(t: pa.Table) -> pa.Table:
            t = t.sort_by([("row", "ascending"), ("col", "ascending")])
            r, c, x = (t.column(k).to_numpy() for k in ("row", "col", "x"))
            on, _ = sk.peel(x & 255, sk.links(r, c), np.ones(len(r), bool), (x & TRIED) != 0, connectivity)
            return pa.table({"row": r[~on], "col": c[~on]})

        gone = cells.groupBy("share", "alone").applyInArrow(finish, "row int, col int")
        return cut_tiles(_with_cells(line, gone, tile, lambda a, m: np.where(m, 0, a & ~U16(TRIED))), "line")
    return line


def _ring(line: np.ndarray, mask: np.ndarray, reach: float, connectivity: int) -> np.ndarray:
    """The line and the cells of the mask within a distance of it that is measured inside the mask, along sight lines."""
    if reach < 1 or not line.any():
        return line
    r, c, link = sk.links_dense(mask)
    n = len(r)
    far = np.full(n + 1, np.inf)
    front = np.flatnonzero(line[r, c])
    far[front] = 0
    lines = sk.sight_lines(reach)
    while len(front):
        before = far.copy()
        for length, path in lines:
            src = front[far[front] + length <= reach]
            to = src
            for k in path:
                to = link[to, k]
            np.minimum.at(far, to, before[src] + length)
        far[n] = np.inf
        front = np.flatnonzero((far < before) & (far + 1 <= reach))
    near = np.zeros(mask.shape, bool)
    near[r, c] = far[:n] <= reach
    out = line
    for _ in range(int(2 * reach) + 1):  # joined by edges
        out = out | (_grown(out, 4) & near)
    return out


def connectors(tiles: DataFrame, mask, core, edge: int, connectivity: int, tile: int = TILE, limit: int = LIMIT) -> DataFrame | None:
    """``row, col, k`` of the cells that connect cores: k is BRIDGE where they join several, else LOOP.

    ``mask(flags)`` are the foreground cells that are no core and joined to one, ``core(flags)`` the
    cores. The mask is thinned towards the cores; what is left, with the cells of the mask
    nearer to it than the edge width (less 0.43: from cell to cell), makes the connectors. Dead
    ends are peeled off wholly, so other cells are branches. None if there is no connector.
    """
    line = _skeleton(tiles, mask, core, edge, connectivity, tile, limit)
    is_line = lambda a: (a & LINE) != 0
    if not _any(line, is_line):
        return None
    reach_ = edge + 0.98 - 2**0.5
    m = int(reach_) + 2
    CELL, NEXT, SIDE = 1, 2, 4
    flat = tiles.withColumnRenamed("data", "flags").join(line.select("tr", "tc", "data"), ["tr", "tc"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for flags, data in zip(b.column("flags").to_pylist(), b.column("data").to_pylist()):
                a = np.frombuffer(flags, U16)
                out.append((mask(a) * CELL | core(a) * NEXT | is_line(np.frombuffer(data, U16)) * SIDE).astype(U16).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tr", "tc", "r0", "c0", "h", "w")), pa.array(out, pa.binary())], names=["tr", "tc", "r0", "c0", "h", "w", "data"])

    JOIN, CORES, BESIDE = 1, 2, 4

    def widen(a: np.ndarray) -> np.ndarray:
        cores = (a & NEXT) != 0
        join = _ring((a & SIDE) != 0, (a & CELL) != 0, reach_, connectivity)
        beside = (join & _grown(cores, connectivity)) | (cores & _grown(join, connectivity))
        return (join * JOIN | cores * CORES | beside * BESIDE).astype(U16)[m:-m, m:-m]

    joined = cut_tiles(map_tiles(over_tiles(flat.select("tr", "tc", "r0", "c0", "h", "w", "flags", "data"), both, TILE_SCHEMA), widen, m, U16, 0), "joined")
    bit = lambda x: lambda a: (a & x) != 0
    found = regions(joined, bit(JOIN), connectivity, dtype=U16)
    ends = _cells_of(found, None, bit(BESIDE), lambda a: a).select("row", "col", "region")
    cores = _cells_of(regions(joined, bit(CORES), connectivity, dtype=U16), None, bit(BESIDE), lambda a: a).select("row", "col", F.col("region").alias("core"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in sk.AROUND if connectivity == 8 or i * j == 0])
    beside = ends.select("region", F.explode(steps).alias("o"), "row", "col").select("region", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    kinds = beside.join(cores, ["row", "col"]).groupBy("region").agg(F.when(F.min("core") < F.max("core"), BRIDGE).otherwise(LOOP).alias("k"))
    cells = _cells_of(found, None, bit(JOIN), lambda a: a).select("row", "col", "region")
    return cells.join(kinds, "region", "left").select("row", "col", F.coalesce("k", F.lit(LOOP)).alias("k"))
