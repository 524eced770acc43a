"""Even shards that keep linked documents together: balanced label propagation."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import cut

__all__ = ["numbered", "place_whole", "balanced_shards"]

log = logging.getLogger(__name__)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, buckets: int = 4096) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each value of ``by`` (few values, many rows).

    Rows are dealt into hash buckets of ``order``; a bucket's rows are numbered by a window, and
    its first number comes from the counts of the buckets before it. No window holds a whole
    value. ``order`` should tell rows apart; rows that it doesn't are numbered in any order.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)) if by else F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__bb"), F.coalesce(before, F.lit(0)).alias("__start"))  # buckets times values of by, at most
    place = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    on = F.col("__b") == F.col("__bb")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = b.withColumn("__place", place).join(F.broadcast(starts), on)
    return rows.withColumn(name, F.col("__start") + F.col("__place")).select(*df.columns, name)


def _room(quota: int, extra: int, shard: Column) -> Column:
    return F.lit(quota) + F.when(shard < extra, 1).otherwise(0)


def _sizes(groups: DataFrame) -> dict[int, int]:
    """How many ``groups(c)`` there are of each size; distinct sizes are few, as their sum is bounded by the rows."""
    return {r.c: r.m for r in groups.groupBy("c").agg(F.count("*").alias("m")).collect()}


def place_whole(sizes: dict[int, int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges ``(size, from, upto, shard)`` of the groups of each size, and the number that found no room.

    ``sizes`` has the number of groups by size. Large ones go first, once to where most room is
    left and once to the fullest shard that takes them; the way that leaves fewer rows over counts.
    """
    best = None
    for even in (True, False):
        free, plan, over, rows = list(room), [], 0, 0
        for c in sorted(sizes, reverse=True):
            most = [max(r, 0) // c for r in free]
            m = min(sizes[c], sum(most))
            over, rows = over + sizes[c] - m, rows + (sizes[c] - m) * c
            x = [0] * len(free)
            if even:

                def takes(level: int) -> list[int]:
                    return [min(t, max(0, -(-(r - level) // c))) for r, t in zip(free, most)]

                low, high = 0, max(free)
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if sum(takes(mid)) >= m else (low, mid - 1)
                x, spare = takes(low), takes(low + 1)
                for s in range(len(x)):
                    if sum(x) > m and x[s] > spare[s]:
                        x[s] -= 1
            else:
                for s in sorted(range(len(free)), key=free.__getitem__):
                    x[s] = min(most[s], m - sum(x))
            at = 0
            for s, k in enumerate(x):
                if k:
                    plan.append((c, at, at + k, s))
                    at, free[s] = at + k, free[s] - k * c
        if best is None or rows < best[0]:
            best = (rows, plan, over)
    return best[1], best[2]


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 10, part: float = 0.25) -> DataFrame:
    """Put every row into a shard; counts of rows differ by one at most.

    Rows of equal text are linked. A group of over ``part`` of a shard is first cut, by a hash
    of doc_id, into parts of about that size, as no shard could take it. Rows start evenly
    spread. In each round a join tells every split group where most of its rows are (ties by a
    hash of group and round), and groups move there whole, in order of a hash, as far as the
    shard has room for linked rows; every other round those that found no seats try a shard
    drawn in proportion to the seats left. Quotas are never exceeded. Groups that are still split
    are then placed whole by :func:`place_whole`; where the settled ones leave no room for all, all
    groups are placed anew if that cuts fewer. The number of groups left cut is logged as a
    warning. Rows without links, and those of cut groups, fill what is left of each shard. Only
    narrow rows are shuffled.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: size is the text's
    UTF-8 bytes plus 8, slot is gapless from 0 in a shard, law is ``rows``, grown_shard null.
    Null texts count as empty ones. Rows equal in doc_id and text are interchangeable. An
    empty table gives an empty result.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select("doc_id", raw.alias("raw")).select("doc_id", (F.octet_length("raw") + F.lit(8)).cast("long").alias("size"), F.crc32("raw").cast("long").alias("text_crc32"), F.xxhash64("raw").alias("h"))
    # a group is known by hash, checksum and size of its text
    base = cut(numbered(base, [], ["doc_id", "h"], "n"), "shard-rows")
    total = base.count()
    quota, extra = divmod(total, shards)
    key = ["h", "text_crc32", "size"]
    groups = base.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    most = max(1, int(part * quota))
    parts = F.pmod(F.xxhash64("n", "doc_id"), F.ceil(F.col("copies") / most).cast("long")).cast("int")
    rows = base.join(groups, key, "left").withColumn("shard", (F.col("n") % shards).cast("int"))
    rows = rows.withColumn("g", F.when(F.col("copies").isNotNull(), F.struct(*key, parts.alias("part")))).select("doc_id", "size", "text_crc32", "h", "n", F.when(F.col("g").isNotNull(), F.xxhash64("g.h", "g.text_crc32", "g.size", "g.part")).alias("g"), "shard")
    rows = cut(rows, "shard-rows")

    # what moves is the group's count in a shard; (g, from, rows)
    spread = cut(rows.where("g is not null").groupBy("g", "shard").agg(F.count("*").alias("c")), "spread")
    buckets = 4096
    for r in range(rounds):
        seats = F.broadcast(_free(spread.groupBy(F.col("shard").alias("s")).agg(F.sum("c").alias("c")), shards, quota, extra))
        tie = F.xxhash64("g", "shard", F.lit(r))
        want = spread.groupBy("g").agg(F.max(F.struct("c", tie.alias("tie"), "shard")).alias("top"), F.sum("c").alias("all")).where("top.c < all").select("g", F.col("top.shard").alias("to"), (F.col("all") - F.col("top.c")).alias("moving"), "all")
        if r % 2:  # those whom the neighbours' shard had no seats for try one that has
            left = total - spread.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
            if not left:  # no seat to move to
                break
            draw = F.pmod(F.xxhash64("g", F.lit(r)), F.lit(left))
            want = want.withColumn("draw", draw).join(seats, (F.col("draw") >= F.col("from")) & (F.col("draw") < F.col("upto"))).select("g", F.col("shard").alias("to"), F.col("all").alias("moving"))
        asks = want.select("g", "to", "moving", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("b"))
        sums = asks.groupBy("to", "b").agg(F.sum("moving").alias("m"))
        ahead = F.coalesce(F.sum("m").over(Window.partitionBy("to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sums.select(F.col("to").alias("t2"), F.col("b").alias("b2"), ahead.alias("ahead"))
        room = F.broadcast(starts.join(seats, F.col("t2") == F.col("shard")).select("t2", "b2", "ahead", (F.col("upto") - F.col("from")).alias("room")))
        inner = F.sum("moving").over(Window.partitionBy("to", "b").orderBy("g"))
        moves = asks.withColumn("inner", inner).join(room, (F.col("to") == F.col("t2")) & (F.col("b") == F.col("b2"))).where(F.col("ahead") + F.col("inner") <= F.col("room")).select("g", "to")
        spread = cut(spread.join(moves, "g", "left").withColumn("shard", F.coalesce("to", "shard")).groupBy("g", "shard").agg(F.sum("c").alias("c")), "spread")
        if not spread.groupBy("g").count().where("count > 1").limit(1).count():
            break

    # rows of settled groups follow them; groups still in several shards are placed whole by size
    state = cut(spread.groupBy("g").agg(F.count("*").alias("k"), F.min("shard").alias("home"), F.sum("c").alias("c")), "groups")
    room = [quota + (s < extra) for s in range(shards)]
    taken = {r.home: r.n for r in state.where("k = 1").groupBy("home").agg(F.sum("c").alias("n")).collect()}
    plan, left = place_whole(_sizes(state.where("k > 1")), [n - taken.get(s, 0) for s, n in enumerate(room)])
    moved = state.where("k > 1")
    if left:  # the settled ones are in the way
        plan_all, left_all = place_whole(_sizes(state), room)
        if left_all < left:
            plan, left, moved = plan_all, left_all, state
    if left:
        log.warning("balanced_shards: %d groups of copies are left cut", left)
    ranges = docs.sparkSession.createDataFrame(plan, "size long, from long, upto long, home int")
    new = numbered(moved.select("g", "c"), ["c"], ["g"], "place").join(F.broadcast(ranges), (F.col("c") == F.col("size")) & (F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto"))).select("g", "home")
    home = new if moved is state else state.where("k = 1").select("g", "home").union(new)
    narrow = ["doc_id", "size", "text_crc32", "h", "n"]
    linked = cut(rows.where("g is not null").join(home, "g", "left").select(*narrow, F.col("home").alias("shard")), "linked")
    loose = rows.where("g is null").select(*narrow).union(linked.where("shard is null").select(*narrow))
    linked = linked.where("shard is not null")
    free = F.broadcast(_free(linked.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("c")), shards, quota, extra))
    single = numbered(loose, [], ["n"], "seat")
    single = single.join(free, (F.col("seat") >= F.col("from")) & (F.col("seat") < F.col("upto"))).select("doc_id", "size", "text_crc32", "h", "n", "shard")
    placed = cut(linked.unionByName(single), "placed")
    out = numbered(placed, ["shard"], ["n"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _free(taken: DataFrame, shards: int, quota: int, extra: int) -> DataFrame:
    """Ranges of seats (from, upto) that linked rows ``taken(s, c)`` leave in each shard; one row a shard."""
    every = taken.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    left = every.join(taken, F.col("shard") == F.col("s"), "left").select("shard", (_room(quota, extra, F.col("shard")) - F.coalesce("c", F.lit(0))).alias("left"))
    w = Window.partitionBy(F.lit(0)).orderBy("shard")
    return left.select("shard", (F.sum("left").over(w) - F.col("left")).alias("from"), F.sum("left").over(w).alias("upto"))
