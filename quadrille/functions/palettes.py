"""Colours of results, by tool and scheme: red, green and blue of each byte value."""

from __future__ import annotations

__all__ = ["SCHEMES", "palette", "legend"]

# Colours, names and the values that have them, one value or first-last. All others are white.
_MSPA = """
220 220 220 Background: 0
255 140 0 Branch: 1 101
0 0 0 Edge: 3 103
0 0 255 Perforation: 5 105
160 60 0 Islet: 9 109
0 200 0 Core: 17 117
255 0 0 Bridge: 33 133
255 255 0 Loop: 65 165
136 136 136 Core opening: 100
194 194 194 Border opening: 220
"""
_TABLES = {
    "frag": """
215 50 40 Rare: 0-9
250 140 90 Patchy: 10-39
255 200 0 Transitional: 40-59
140 200 100 Dominant: 60-89
0 175 0 Interior: 90-100
175 175 175 Background: 101
0 100 255 Special background 3: 105
0 200 255 Special background 4: 106
""",
    "change": """
60 130 90 High increase: 0-79
90 170 130 Medium increase: 80-89
130 210 170 Low increase: 90-98
240 240 200 Insignificant: 99-101
255 215 100 Low decrease: 102-110
255 150 40 Medium decrease: 111-120
205 75 0 High decrease: 121-200
0 255 0 Gain: 250
0 0 0 Loss: 251
225 225 225 Background: 252
0 100 255 Special background: 253
""",
    "acc": """
220 220 220 Background: 0
255 140 0 : 1
160 60 0 : 9
0 200 0 : 17
255 0 0 : 33
255 255 0 : 65
0 0 0 : 103
0 0 255 Special background 3: 105
190 190 255 Special background 4: 176
""",
    "mosaic_agr": """
110 80 255 Agriculture dominant: 41-45 51-55 101-104 180-182
140 140 140 Agriculture minor: 61-65 91-95 151-155 170-172 190-192
240 240 70 Agriculture subdominant: 71-75 81-85 111-114 121-124 131-135 141-145 200-236
""",
    "mosaic_ant": """
247 104 161 High: 41-45 65 101-103 134-135 154-155 180-182 202-206 220-227 235
240 130 60 Medium: 51-55 95 104 141-143 151-153 207-212 215-219 228-234 236
197 27 138 Very high: 61-64 71-75 111-114 131-133 200-201
254 235 226 Very low: 81 170-172
252 197 192 Low: 82-85 91-94 121-124 144-145 213-214
122 1 119 Extreme: 190-192
""",
    "mosaic_bgr": """
25 40 240 Agriculture: 41-45 51-55 101-104 180-182
230 50 35 Developed: 61-65 71-75 111-114 190-192
125 250 75 Natural: 81-85 91-95 121-124 170-172
140 140 140 Mixed: 131-135 141-145 151-155 200-236
""",
    "mosaic_dev": """
255 180 20 Developed subdominant: 41-45 91-95 101-104 121-124 131-135 151-155 200-236
140 140 140 Developed minor: 51-55 81-85 141-145 170-172 180-182
255 20 140 Developed dominant: 61-65 71-75 111-114 190-192
""",
    "mosaic_div": """
180 220 240 Dual: 41-45 51-55 61-65 71-75 81-85 91-95 131-135 141-145 151-155
250 180 100 Triple: 101-104 111-114 121-124 200-206 208-214 216-222
50 140 190 Uniform: 170-172 180-182 190-192
220 25 25 Intermix: 207 215 223-236
""",
    "mosaic_nat": """
140 140 140 Natural minor: 41-45 71-75 131-135 180-182 190-192
180 140 20 Natural subdominant: 51-55 61-65 101-104 111-114 141-145 151-155 200-236
20 140 20 Natural dominant: 81-85 91-95 121-124 170-172
""",
    "mosaic_groups": """
0 0 255 A: 1
255 0 0 D: 2
0 255 0 N: 3
128 0 255 Ad: 4
0 128 255 An: 5
255 128 0 Dn: 6
255 0 128 Da: 7
0 255 128 Na: 8
128 255 0 Nd: 9
128 128 255 Adn: 10
255 128 128 Dan: 11
128 255 128 Nad: 12
128 0 128 ad: 13
0 128 128 an: 14
128 128 0 dn: 15
128 128 128 adn: 16
0 191 0 NN: 17
0 0 191 AA: 18
191 0 0 DD: 19
""",
    # crossings of rims in the colour of the connector, or (mspa_plain) of the rim
    "mspa": _MSPA + "255 0 0 Bridge in a rim: 35 37 135 137\n255 255 0 Loop in a rim: 67 69 167 169\n",
    "mspa_plain": _MSPA + "0 0 0 Connector in an edge: 35 67 135 167\n0 0 255 Connector in a perforation: 37 69 137 169\n",
}
_TABLES["spa"] = _TABLES["mspa"]
SCHEMES = ("agr", "ant", "bgr", "dev", "div", "nat")
WHITE = (255, 255, 255)


def legend(name: str) -> list[tuple[str, tuple[int, int, int], list[int]]]:
    """Name, colour and values of each entry of a palette, in order."""
    out = []
    for line in _TABLES[name].strip().split("\n"):
        head, _, values = line.partition(":")
        r, g, b, *words = head.split()
        spans = [(int(a), int(z or a)) for a, _, z in (x.partition("-") for x in values.split())]
        out.append((" ".join(words), (int(r), int(g), int(b)), [v for a, z in spans for v in range(a, z + 1)]))
    return out


def palette(name: str) -> dict[int, tuple[int, int, int]]:
    """The colour of each of the 256 byte values."""
    return dict.fromkeys(range(256), WHITE) | {v: rgb for _, rgb, values in legend(name) for v in values}
