"""Codes of the landscape mosaic: 103 classes by deciles of three shares, and 19 groups of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["CODES", "GROUPS", "GROUP_NAMES", "mosaic_code", "mosaic_codes", "group_of", "mosaic_group", "PURE"]

#: By decile of natural (line) and agriculture (entry): the code where developed fills the rest
#: of the decile, and where it doesn't. The last entry of a line has one code.
_LINES = """
191/192 71/72 73/74 75/131 132/133 134/135 45/44 43/42 41/182 181
61/62 111/112 114/200 201/202 203/204 205/206 103/102 101/52 51
63/64 113/222 223/224 225/226 227/228 207/208 104/54 53
65/155 221/220 235/234 236/230 229/210 209/141 55
154/153 219/218 233/232 231/212 211/143 142
152/151 217/216 215/214 213/145 144
95/94 124/122 123/84 85
93/92 121/82 83
91/172 81
171
"""
#: Codes of windows of one class only.
PURE = {1: 180, 2: 170, 3: 190}
GROUP_NAMES = dict(enumerate("A D N Ad An Dn Da Na Nd Adn Dan Nad ad an dn adn NN AA DD".split(), 1))


def _table() -> np.ndarray:
    t = np.zeros((10, 10, 2), np.int64)  # natural, agriculture, whether developed fills
    for f, line in enumerate(_LINES.split("\n")[1:-1]):
        for a, entry in enumerate(line.split()):
            high, _, low = entry.partition("/")
            t[f, a] = int(low or high), int(high)
    return t


_TABLE = _table()
CODES = sorted({int(x) for x in _TABLE.ravel() if x} | set(PURE.values()))


def group_of(code: int) -> int:
    """The group (1-19) of a code; 0 for no data."""
    if code == 0:
        return 0
    if code < 156:
        return code // 10
    if code >= 200:
        return 16
    return {17: 3, 18: 1, 19: 2}[code // 10] if code % 10 else code // 10


GROUPS = {c: group_of(c) for c in [0, *CODES]}


def mosaic_codes(n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
    """Codes of windows with these counts of agriculture, natural and developed cells."""
    n = n1 + n2 + n3
    d = np.maximum(n, 1)
    f = np.minimum(10 * n2 // d, 9)
    a = np.minimum(10 * n1 // d, 9 - f)
    code = _TABLE[f, a, (10 * n3 >= (9 - f - a) * n).astype(int)]
    return np.select([n == 0, n2 == n, n3 == n, n1 == n], [0, PURE[2], PURE[3], PURE[1]], code)


def mosaic_code(n1: Column, n2: Column, n3: Column) -> Column:
    """The same of columns; the table is a literal array."""
    n = n1 + n2 + n3
    d = F.greatest(n, F.lit(1))
    tenth = lambda x: ((10 * x - (10 * x) % d) / d).cast("int")
    f = F.least(tenth(n2), F.lit(9))
    a = F.least(tenth(n1), 9 - f)
    at = f * 20 + a * 2 + (10 * n3 >= (9 - f - a) * n).cast("int")
    table = F.array(*[F.lit(int(x)) for x in _TABLE.ravel()])
    return F.when(n == 0, 0).when(n2 == n, PURE[2]).when(n3 == n, PURE[3]).when(n1 == n, PURE[1]).otherwise(F.get(table, at))


def mosaic_group(code: Column) -> Column:
    """The group of a code, 0 for no data and unknown codes."""
    m = F.create_map(*[F.lit(x) for k, v in GROUPS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(m, code.cast("int")), F.lit(0))
