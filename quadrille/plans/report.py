"""Tables and texts that go with a result: histograms as CSV, plain reports, palettes, tags."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import statistics as st
from quadrille.functions.mosaic import _TABLE

__all__ = ["fragmentation_table", "change_table", "mosaic_table", "ternary_table", "write_heatmap", "write_csv", "report_text", "elapsed", "renew_time", "parse_palette", "make_tag", "parse_tag"]

#: Kinds of tags: the word after the prefix, the tool, and the names of its parameters in order.
TAGS = {
    "FOS": ("frag", ("kind", "threshold", "connectivity", "method", "pixel", "window")),
    "FOSCHANGE": ("change", ("kind", "threshold", "connectivity", "method", "pixel", "window")),
    "LM": ("mosaic", ("window", "colors")),
    "SPA": ("spa", ("edge", "classes")),
    "MSPA": ("mspa", ("connectivity", "edge", "transition", "intext")),
    "ACC": ("acc", ("thresholds",)),
}
PREFIX = "QDR"


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def fragmentation_table(result: DataFrame) -> DataFrame:
    """``pixel_value, pixel_count, foreground_proportion`` (in percent) of 0 to 100, zeros too."""
    return st.full_histogram(result).select(F.col("v").alias("pixel_value"), F.col("n").alias("pixel_count"), _fixed(100 * F.col("share"), 6).alias("foreground_proportion"))


def change_table(result: DataFrame) -> DataFrame:
    """The same of 0 to 200, with ``Delta_FAD`` = 100 - value."""
    h = st.change_histogram(result)
    return h.select(F.col("v").alias("pixel_value"), F.col("delta").alias("Delta_FAD"), F.col("n").alias("pixel_count"), _fixed(F.col("pct"), 6).alias("foreground_proportion"))


def mosaic_table(result: DataFrame) -> DataFrame:
    """``pixel_value, pixel_count, foreground_proportion`` (in percent) of the codes that occur, no data left out."""
    h = st.histogram(result).where("v > 0")
    total = h.agg(F.sum("n").alias("total"))
    return h.crossJoin(F.broadcast(total)).select(F.col("v").cast("long").alias("pixel_value"), F.col("n").alias("pixel_count"), _fixed(100 * F.col("n") / F.col("total"), 6).alias("foreground_proportion"))


def ternary_table(result: DataFrame) -> DataFrame:
    """The mosaic as a triangle: a row per decile of natural, a column per decile of agriculture
    and half of it, percentages with three decimals; what is outside the triangle is null."""
    places = [(f, a, high, int(_TABLE[f, a, high])) for f in range(10) for a in range(10 - f) for high in (0, 1)]
    spark = result.sparkSession
    grid = spark.createDataFrame(places, "natural long, agriculture long, high long, v long").dropDuplicates(["natural", "v"])
    h = mosaic_table(result).select(F.col("pixel_value").alias("v"), F.col("foreground_proportion").cast("double").alias("p"))
    cells = grid.join(F.broadcast(h), "v", "left").select("natural", F.concat(F.lit("a"), F.col("agriculture"), F.when(F.col("high") == 1, "_developed").otherwise("")).alias("at"), _fixed(F.coalesce("p", F.lit(0.0)), 3).alias("pct"))
    names = [f"a{a}{x}" for a in range(10) for x in ("_developed", "")]
    return cells.groupBy("natural").pivot("at", names).agg(F.first("pct")).orderBy(F.desc("natural"))


def write_heatmap(result: DataFrame, path: str, window: int) -> None:
    """The mosaic's percentages as a triangle in a CSV file of 22 columns: natural at the top,
    developed and agriculture at the lower corners, one line a decile of natural."""
    share = {r.pixel_value: float(r.foreground_proportion) for r in mosaic_table(result).collect()}  # at most 103 rows
    show = lambda codes: [f"{share.get(c, 0.0):.3f}" for c in codes]
    lines = [[f"Landscape Mosaic using Window size ({window}x{window})", *[" "] * 21], [" "] * 11 + show([170]) + [" "] * 10]
    for f in range(9, -1, -1):
        codes = [int(c) for a in range(10 - f) for c in dict.fromkeys((_TABLE[f, a, 1], _TABLE[f, a, 0]))]
        lines.append([" "] * (2 + f) + show(codes) + [" "] * (1 + f))
    lines.append([" ", *show([190]), *[" "] * 19, *show([180])])
    with open(path, "w", encoding="utf-8", newline="") as out:
        csv.writer(out).writerows(lines)


def write_csv(table: DataFrame, path: str, by: str | None = None) -> None:
    """One CSV file (of a few hundred rows) in a folder, with a header, in order of ``by``."""
    (table.orderBy(by) if by else table).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_text(title: str, parts: Mapping[str, Mapping[str, object]]) -> str:
    """A plain report: sections of ``name: value`` lines; numbers with up to six decimals."""
    show = lambda x: "-" if x is None else f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
    lines = [title, "=" * len(title)]
    for head, values in parts.items():
        width = max(map(len, values), default=0)
        lines += ["", head, "-" * len(head), *(f"{k:<{width}} : {show(v)}" for k, v in values.items())]
    return "\n".join(lines) + "\n"


def elapsed(seconds: float) -> str:
    """Hours, minutes and seconds, without leading parts that are zero."""
    whole = int(seconds)
    h, m, s = whole // 3600, whole % 3600 // 60, seconds - whole // 60 * 60
    return f"{h} h {m} min {s:.0f} s" if h else f"{m} min {s:.0f} s" if m else f"{s:.2f} s"


def renew_time(text: str, seconds: float) -> tuple[str, bool]:
    """A report whose ``Computational time`` line says something else, and whether there is one."""
    out, n = re.subn(r"(?m)^(Computational time\s*:).*$", lambda m: f"{m[1]} {elapsed(seconds)}", text, count=1)
    return out, bool(n)


def parse_palette(lines: Iterable[str]) -> dict[int, tuple[int, int, int]]:
    """Value, red, green, blue a line; lines with less than four fields or no numbers are left out."""
    out = {}
    for x in lines:
        f = x.split()
        if len(f) >= 4 and all(v.lstrip("-").isdigit() for v in f[:4]):
            out[int(f[0])] = (int(f[1]), int(f[2]), int(f[3]))
    return out


def make_tag(tool: str, **values: object) -> str:
    """The line that says how a raster was made: ``PREFIX_KIND, <values>``."""
    kind, names = next((k, n) for k, (t, n) in TAGS.items() if t == tool)
    flat = [str(int(v)) if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for v in (values[n] for n in names)]
    return f"{PREFIX}_{kind}, <{','.join(flat)}>"


def parse_tag(text: str | None) -> dict[str, object] | None:
    """``tool`` and its parameters as strings (thresholds as a list); None if it is no such line.

    Any prefix is taken, so results of other programs that write this form are understood.
    """
    m = re.match(r"\s*[A-Z]+_([A-Z]+)\s*,\s*<([^>]+)>", text or "")
    if not m or m[1] not in TAGS:
        return None
    tool, names = TAGS[m[1]]
    values = [v.strip() for v in m[2].split(",")]
    if tool == "acc":
        return {"tool": tool, "thresholds": values}
    return {"tool": tool, **dict(zip(names, values))} if len(values) >= len(names) else None
