"""Thinning that keeps connections and doesn't depend on the order of cells, on any set of cells.

In each round all cells go together that connect nothing (simple cells), stay simple whichever
single neighbour goes with them, and are not part of an isolated group of three or four that
would vanish as a whole (after Iwanowski and Soille 2007). Only neighbours of what has gone
are looked at in the next round.
"""

from __future__ import annotations

import numpy as np

__all__ = ["AROUND", "simple_codes", "links", "links_dense", "peel", "sight_lines"]

#: The neighbours of a cell in a circle; bit k of a code tells of neighbour k. Odd ones share an edge.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
BIT = np.array([1 << k for k in range(8)], np.int32)
EDGES = sum(1 << k for k in (1, 3, 5, 7))
CHUNK = 1 << 16


def simple_codes(connectivity: int) -> np.ndarray:
    """Of each code of neighbours, whether a cell with these goes without joining or parting anything.

    With eight neighbours: one part of the background shares an edge with the cell. With four: one
    part of the foreground does.
    """
    out = np.zeros(256, bool)
    for code in range(256):
        on = [code >> k & 1 for k in range(8)]
        if connectivity == 8:
            parts = sum(not on[k] and bool(on[(k + 1) % 8] or on[(k + 2) % 8]) for k in (1, 3, 5, 7))
        else:
            parts = sum(on[k] and not (on[(k + 1) % 8] and on[(k + 2) % 8]) for k in (1, 3, 5, 7))
        out[code] = parts == 1
    return out


def links(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each cell the indices of its eight neighbours among the cells, n where there is none.

    The last row is of the cell that isn't there. Cells are in order of row and column.
    """
    n = len(row)
    key = (row.astype(np.int64) << 32) + col
    out = np.full((n + 1, 8), n, np.int32)
    for k, (i, j) in enumerate(AROUND):
        want = key + (i << 32) + j
        at = np.minimum(np.searchsorted(key, want), n - 1) if n else np.empty(0, np.int64)
        out[:n, k] = np.where(key[at] == want, at, n) if n else 0
    return out


def links_dense(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of a mask's cells, and :func:`links` of them."""
    r, c = np.nonzero(mask)
    at = np.full((mask.shape[0] + 2, mask.shape[1] + 2), len(r), np.int32)
    at[r + 1, c + 1] = np.arange(len(r))
    return r, c, np.concatenate([np.stack([at[r + 1 + i, c + 1 + j] for i, j in AROUND], 1), np.full((1, 8), len(r), np.int32)])


def _codes(near: np.ndarray, link: np.ndarray, on: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return near[cells] | on[link[cells]] @ BIT


def _may_go(near: np.ndarray, link: np.ndarray, on: np.ndarray, cells: np.ndarray, simple: np.ndarray, connectivity: int) -> np.ndarray:
    """Which of some simple cells may go together with all others that may."""
    own, beside = _codes(near, link, on, cells), link[cells]
    codes = _codes(near, link, on, beside.ravel()).reshape(beside.shape)
    goes = on[beside] & simple[codes]
    held = goes & ~simple[own[:, None] & ~BIT]  # without that one the cell is needed
    ok = ~held.any(axis=1)
    count = goes.sum(axis=1)
    size = np.bitwise_count(codes.astype(np.uint8))
    shared = np.zeros(beside.shape, np.int64)  # neighbours in common with the cell, of a neighbour
    for k in range(8):
        others = [m for m in range(8) if m != k and max(abs(AROUND[m][0] - AROUND[k][0]), abs(AROUND[m][1] - AROUND[k][1])) == 1]
        shared[:, k] = np.bitwise_count((own & sum(1 << m for m in others)).astype(np.uint8))
    alone = (count >= 2) & (count <= 3) & (~goes | ((size == count[:, None]) & (shared == count[:, None] - 1))).all(axis=1)
    ok &= ~alone
    if connectivity == 4:  # a corner held by the cell across alone, when both between go as well
        across = held[:, ::2]
        corner = (across.sum(axis=1) == 1) & ~held[:, 1::2].any(axis=1) & (np.bitwise_count((own & EDGES).astype(np.uint8)) == 2)
        k = across.argmax(axis=1) * 2
        every = np.arange(len(cells))
        corner &= goes[every, (k + 1) % 8] & goes[every, (k - 1) % 8]
        edges = np.bitwise_count((codes & EDGES).astype(np.uint8))[:, 1::2]
        ok |= corner & (goes[:, 1::2] & (edges != 2)).any(axis=1)  # not an isolated square
    return ok


def peel(near: np.ndarray, link: np.ndarray, on: np.ndarray, tried: np.ndarray, connectivity: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the cells after some rounds, or for good, and which cells the next round would try.

    ``near`` has each cell's code of the neighbours that never go, ``link`` comes from
    :func:`links`, ``on`` tells which cells are there and ``tried`` which are tried first.
    """
    simple, n = simple_codes(connectivity), len(on)
    near, on = np.append(near.astype(np.int32), 0), np.append(on, False)
    active = np.flatnonzero(np.append(tried, False) & on)
    done = 0
    while len(active) and (rounds is None or done < rounds):
        gone = []
        for a in range(0, len(active), CHUNK):
            part = active[a : a + CHUNK]
            part = part[simple[_codes(near, link, on, part)]]
            if len(part):
                gone.append(part[_may_go(near, link, on, part, simple, connectivity)])
        gone = np.concatenate(gone) if gone else active[:0]
        on[gone] = False
        active = np.unique(link[gone])
        active = active[on[active]]
        done += 1
    left = np.zeros(n, bool)
    left[active] = True
    return on[:n], left


def sight_lines(reach: float) -> list[tuple[float, list[int]]]:
    """Straight lines of cells from a cell to each other one within ``reach``: length and steps (places in AROUND), short ones first."""
    out, most = [], int(reach)
    step = {d: k for k, d in enumerate(AROUND)}
    for i in range(-most, most + 1):
        for j in range(-most, most + 1):
            length = (i * i + j * j) ** 0.5
            if not 0 < length <= reach:
                continue
            long, short = max(abs(i), abs(j)), min(abs(i), abs(j))
            path, at = [], 0
            for t in range(1, long + 1):
                side = (2 * t * short + long) // (2 * long)
                a, b = 1, side - at
                at = side
                di, dj = (a, b) if abs(i) >= abs(j) else (b, a)
                path.append(step[di * (1 if i > 0 else -1), dj * (1 if j > 0 else -1)])
            out.append((length, path))
    return sorted(out)
