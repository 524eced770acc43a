"""Statistics of rasters: histograms, class shares and derived indices, as one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.mosaic import mosaic_group
from quadrille.operators.tiles import in_tiles, tile_histogram

__all__ = ["histogram", "full_histogram", "fragmentation_stats", "gray_stats", "mosaic_stats", "mosaic_groups", "spa_stats", "mspa_stats", "change_stats", "change_histogram", "window_area", "FRAGMENTATION_CLASSES", "CHANGE_BINS"]

FRAGMENTATION_CLASSES = {"rare": (0, 9), "patchy": (10, 39), "transitional": (40, 59), "dominant": (60, 89), "interior": (90, 100)}
#: Change codes (100 + before - after) by strength; below 100 connectivity rose.
CHANGE_BINS = {"high_increase": (0, 79), "medium_increase": (80, 89), "low_increase": (90, 98), "insignificant": (99, 101), "low_decrease": (102, 110), "medium_decrease": (111, 120), "high_decrease": (121, 200)}


def histogram(cells: DataFrame) -> DataFrame:
    """``v, n`` of the values that occur, of a raster in cells or tiles."""
    if in_tiles(cells):
        return tile_histogram(cells)
    return cells.groupBy("v").agg(F.count("*").alias("n"))


def full_histogram(cells: DataFrame, first: int = 0, last: int = 100) -> DataFrame:
    """``v, n, share`` of every value of a range, zeros too; share of the range's cells."""
    h = histogram(cells).where(F.col("v").between(first, last)).select(F.col("v").cast("long").alias("v"), "n")
    every = cells.sparkSession.range(first, last + 1).select(F.col("id").alias("v"))
    out = every.join(F.broadcast(h), "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("v", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")


def _share(n: Column, d: Column, scale: float = 100.0) -> Column:
    return F.when(d > 0, n / d * scale).otherwise(0.0)


def fragmentation_stats(result: DataFrame) -> DataFrame:
    """Of a fragmentation result: counts of five classes and codes, mean over the foreground
    (``fad_av``), mean over all reporting land (``avcon``) and class percentages."""
    v = F.col("v")
    base = histogram(result).agg(
        *[_count(v.between(*x)).alias(k) for k, x in FRAGMENTATION_CLASSES.items()],
        _count(v <= 100).alias("foreground"), _count(v == 101).alias("background"), _count(v == 102).alias("missing"), _count(v == 105).alias("special_3"), _count(v == 106).alias("special_4"),
        F.coalesce(F.sum(F.when(v <= 100, v * F.col("n"))), F.lit(0)).cast("long").alias("total"),
    )
    land = F.col("foreground") + F.col("background") + F.col("special_3") + F.col("special_4")
    base = base.withColumn("reporting_unit", land)
    return base.select(
        "*", _share(F.col("total"), F.col("foreground"), 1.0).alias("fad_av"), _share(F.col("total"), land, 1.0).alias("avcon"),
        *[_share(F.col(k), F.col("foreground")).alias(f"{k}_pct") for k in FRAGMENTATION_CLASSES], _share(F.col("foreground"), land).alias("foreground_pct"),
    )


def gray_stats(source: DataFrame, result: DataFrame) -> DataFrame:
    """As :func:`fragmentation_stats`, with the counts of the source before the threshold. The
    reporting unit is foreground and background of the result."""
    v = F.col("v")
    before = histogram(source).agg(_count(v.between(1, 100)).alias("source_foreground"), _count(v == 0).alias("source_background"), _count(~v.between(0, 100)).alias("source_missing"))
    out = fragmentation_stats(result).drop("special_3", "special_4", "avcon", "foreground_pct", "reporting_unit")
    land = F.col("foreground") + F.col("background")
    return out.crossJoin(F.broadcast(before)).select("*", land.alias("reporting_unit"), _share(F.col("total"), land, 1.0).alias("avcon"), _share(F.col("foreground"), land).alias("foreground_pct"))


def mosaic_groups(result: DataFrame) -> DataFrame:
    """``grp, n, pct`` of the 19 groups that occur, no data left out."""
    h = histogram(result).where("v > 0").groupBy(mosaic_group(F.col("v")).cast("long").alias("grp")).agg(F.sum("n").cast("long").alias("n"))
    total = h.agg(F.sum("n").alias("total"))
    return h.crossJoin(F.broadcast(total)).select("grp", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def mosaic_stats(result: DataFrame) -> DataFrame:
    """Counts and the group of the largest share; among equals the one whose number is smallest."""
    v = F.col("v")
    counts = histogram(result).agg(_count(v > 0).alias("data"), _count(v == 0).alias("missing"), F.count(F.when(v > 0, 1)).alias("codes"))
    top = mosaic_groups(result).agg(F.max(F.struct(F.col("n"), (-F.col("grp")).alias("g"), F.col("pct"))).alias("x")).select((-F.col("x.g")).alias("top_group"), F.col("x.n").alias("top_n"), F.col("x.pct").alias("top_pct"))
    return counts.crossJoin(F.broadcast(top))


SPA_CODES = {"core": 17, "edge": 3, "perforation": 5, "islet": 9, "margin": 1, "core_opening": 100, "background": 0, "missing": 129}


def spa_stats(result: DataFrame) -> DataFrame:
    """Counts by class; foreground is all but background and missing, so core openings count,
    and the percentages are of that."""
    v = F.col("v")
    base = histogram(result).agg(*[_count(v == c).alias(k) for k, c in SPA_CODES.items()], F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cells"))
    fg = F.col("cells") - F.col("background") - F.col("missing")
    return base.withColumn("foreground", fg).select("*", *[_share(F.col(k), F.col("foreground")).alias(f"{k}_pct") for k in list(SPA_CODES)[:6]])


#: Codes of the eleven classes outside; 100 is added inside.
MSPA_CODES = {"Core": 17, "Edge": 3, "Perforation": 5, "Islet": 9, "Branch": 1, "Loop": 65, "Loop in Edge": 67, "Loop in Perf.": 69, "Bridge": 33, "Bridge in Edge": 35, "Bridge in Perf.": 37}
MSPA_CLASSES = {"core": (17,), "edge": (3, 35, 67), "perforation": (5, 37, 69), "islet": (9,), "branch": (1,), "loop": (65,), "bridge": (33,)}


def mspa_stats(result: DataFrame) -> DataFrame:
    """Seven classes, inside or outside (100 added); crossings of edges and perforations count
    there. Integral foreground and porosity as derived indices."""
    v = F.col("v")
    base = histogram(result).agg(
        *[_count(v.isin(*c, *[x + 100 for x in c])).alias(k) for k, c in MSPA_CLASSES.items()],
        _count(v == 100).alias("core_opening"), _count(v == 220).alias("border_opening"), _count(v == 0).alias("background"), _count(v == 129).alias("missing"),
    )
    fg = sum((F.col(k) for k in MSPA_CLASSES), F.lit(0))
    base = base.withColumn("foreground", fg).withColumn("continuous", F.col("core") + F.col("edge") + F.col("perforation"))
    return base.select(
        "*", *[_share(F.col(k), F.col("foreground")).alias(f"{k}_pct") for k in MSPA_CLASSES],
        (F.col("foreground") + F.col("core_opening") + F.col("border_opening")).alias("integral_foreground"),
        F.when(F.col("continuous") + F.col("core_opening") > 0, 100 - 100 * F.col("continuous") / (F.col("continuous") + F.col("core_opening"))).otherwise(0.0).alias("porosity"),
    )


def change_histogram(change: DataFrame) -> DataFrame:
    """``v, n, delta, pct`` of change codes 0-200: delta is 100 - v, pct of the common foreground."""
    h = full_histogram(change, 0, 200)
    return h.select("v", "n", (100 - F.col("v")).alias("delta"), (F.col("share") * 100).alias("pct"))


def change_stats(crosstab: DataFrame) -> DataFrame:
    """From a cross-tabulation ``a, b, n``: seven bins of change, gains and losses, unchanged,
    increased and decreased classes, and the means of both dates."""
    a, b = F.col("a"), F.col("b")
    code = 100 + a - b
    both = (a <= 100) & (b <= 100)
    k = lambda c: F.when(c <= 100, sum((F.when(c >= x[0], 1).otherwise(0) for x in FRAGMENTATION_CLASSES.values()), F.lit(0))).otherwise(0)  # noqa: E731  0 is background
    land = lambda c: (c <= 101)
    weight = lambda c: F.coalesce(F.sum(F.when(c <= 100, c * F.col("n"))), F.lit(0)).cast("long")
    x = crosstab.agg(
        *[_count(both & code.between(*r)).alias(n) for n, r in CHANGE_BINS.items()],
        _count(both).alias("common"), _count((a == 101) & (b <= 100)).alias("gain"), _count((a <= 100) & (b == 101)).alias("loss"),
        _count(both & (k(a) == k(b))).alias("unchanged"), _count(land(a) & land(b) & (k(b) > k(a))).alias("increase"), _count(land(a) & land(b) & (k(b) < k(a))).alias("decrease"),
        _count(a <= 100).alias("a_foreground"), _count(b <= 100).alias("b_foreground"),
        _count((a <= 101) | a.isin(105, 106)).alias("a_land"), _count((b <= 101) | b.isin(105, 106)).alias("b_land"), weight(a).alias("a_total"), weight(b).alias("b_total"),
    )
    return x.select("*", *[_share(F.col(f"{d}_total"), F.col(f"{d}_{w}"), 1.0).alias(f"{d}_{n}") for d in "ab" for w, n in (("foreground", "fad_av"), ("land", "avcon"))])


def change_differences(crosstab: DataFrame) -> DataFrame:
    """Both means at both dates, what the second has more, and that in proportion to the first (0 of nothing)."""
    s = change_stats(crosstab)
    more = lambda n: F.col(f"b_{n}") - F.col(f"a_{n}")
    return s.select(*[c for n in ("fad_av", "avcon") for c in (f"a_{n}", f"b_{n}", more(n).alias(f"{n}_difference"), F.when(F.col(f"a_{n}") > 0, more(n) / F.col(f"a_{n}")).otherwise(0.0).alias(f"{n}_relative"))])


def window_area(window: int, res_x: float, res_y: float, unit: str = "metre") -> dict[str, float] | None:
    """Hectares and acres of a window; None where cells aren't in metres."""
    if not unit.startswith("met"):
        return None
    m2 = window * window * abs(res_x) * abs(res_y)
    return {"hectares": m2 / 10_000, "acres": m2 * 0.000247105}
