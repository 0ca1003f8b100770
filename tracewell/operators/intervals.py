"""Points in ranges as an equality join.

A range of whole numbers is cut into dyadic segments: (level, index) stands for the numbers whose bits above `level` are
`index`, and a range of n numbers is 2 log2(n) of them at most.  A point lies in exactly one segment of each level, so it is
in a range exactly if one of its ancestors is among the range's segments, and two rows meet once.  A join on the segment
has no condition left to test: it makes only rows that are wanted, where a join on the key alone tests every point of a
key against every range of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import col
from tracewell.plans.materialize import counted

#: Ranges of one key that are tested one by one; of a key with more, segments are joined.
TOGETHER = 256
#: Slots of keys with more ranges, of which at most so many are broadcast.
SLOTS = 1 << 20


def segments(start, end) -> Column:
    """Array of (level, index) of the dyadic segments of the whole numbers from start to end, both included; of a range
    without numbers, or with an unknown end, an empty one."""
    first, after = col(start).cast("long"), col(end).cast("long") + 1
    steps = F.when(after > first, F.floor(F.log2((after - first).cast("double"))).cast("int") + 2)
    none = F.expr("cast(array() as array<struct<level:int,index:bigint>>)")
    segment = lambda level, index: F.array(F.struct(level.cast("int").alias("level"), index.alias("index")))

    def step(s: Column, level: Column) -> Column:
        odd_first = (s["first"] < s["after"]) & (F.pmod(s["first"], F.lit(2)) == 1)
        first = s["first"] + odd_first.cast("long")
        odd_after = (first < s["after"]) & (F.pmod(s["after"], F.lit(2)) == 1)
        after = s["after"] - odd_after.cast("long")
        found = F.concat(s["found"], F.when(odd_first, segment(level, s["first"])).otherwise(none), F.when(odd_after, segment(level, after)).otherwise(none))
        return F.struct(F.shiftright(first, 1).alias("first"), F.shiftright(after, 1).alias("after"), found.alias("found"))

    begin = F.struct(first.alias("first"), after.alias("after"), none.alias("found"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), steps), begin, step, lambda s: s["found"]), none)


def ancestors(point, levels: list[int]) -> Column:
    """Array of (level, index) of the segments of these levels that hold a whole number."""
    p = col(point).cast("long")
    return F.array(*(F.struct(F.lit(k).cast("int").alias("level"), F.shiftright(p, k).alias("index")) for k in levels))


def segment_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str) -> DataFrame:
    """points join ranges on the keys `on` where point lies in the range, by segments."""
    cut = ranges.withColumn("__s", F.explode(segments(start, end)))
    used = cut.agg(F.bit_or(F.expr("shiftleft(1L, __s.level)"))).first()[0] or 0
    levels = [k for k in range(64) if used >> k & 1]
    if not levels:
        return points.join(ranges, on).limit(0)
    at = points.withColumn("__s", F.explode(ancestors(point, levels)))
    key = lambda df: df.withColumns({"__level": F.col("__s.level"), "__index": F.col("__s.index")}).drop("__s")
    return key(at).join(key(cut), [*on, "__level", "__index"]).drop("__level", "__index")


def interval_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, together: int = TOGETHER, by: list[str] | None = None) -> DataFrame:
    """points join ranges on the keys `on` where point lies in the range, ends included: keys with few ranges test them one
    by one, others join segments.  No column but the keys may be on both sides.

    by: some of the keys, by which few ranges are told and met, so that ranges that lie dealt out by these stay there."""
    by = by or on
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS))
    many, (n,) = counted(ranges.groupBy(*by).count().where(F.col("count") > together).select(slot.alias("__slot")).distinct())
    within = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))

    def tested(points: DataFrame, ranges: DataFrame) -> DataFrame:
        other = [c for c in on if c not in by]
        met = points.join(ranges.withColumnsRenamed({c: f"__{c}" for c in other}), by).where(within)
        for c in other:
            met = met.where((F.col(c) >= F.col(f"__{c}")) & (F.col(c) <= F.col(f"__{c}")))  # an equality would become a key of the join, and ranges be dealt out anew
        return met.select(*on, *(c for c in (*points.columns, *ranges.columns) if c not in on))

    if not n:
        return tested(points, ranges)
    part = lambda df, how: df.withColumn("__slot", slot).join(F.broadcast(many), "__slot", how).drop("__slot")
    few = tested(part(points, "left_anti"), part(ranges, "left_anti"))
    return few.unionByName(segment_join(part(points, "left_semi"), part(ranges, "left_semi"), on, point, start, end))


#: Bits of the numbers of a cell in which points meet sums of ranges, and how many more the next size of cells has.
CELL_BITS, MORE_BITS = 16, 4


def _totals(points: pa.Table, events: pa.Table) -> pa.Table:
    """Of a cell's points: how many ranges hold them, the least start and the greatest end of those.

    In order of starts, the greatest end so far tells both: the first place at which it reaches a point is the first range
    that does, and at the last start up to a point it is the greatest end."""
    events = events.sort_by("__at")
    at, ends = events.column("__at").to_numpy(), np.maximum.accumulate(events.column("__last").to_numpy())
    begun, over = (np.concatenate([[0], np.cumsum(events.column(c).to_numpy())]) for c in ("__begin", "__over"))
    p = points.column("__point").to_numpy()
    upto = np.searchsorted(at, p, "right")
    n = begun[upto] - over[np.searchsorted(at, p, "left")]
    held = np.flatnonzero(n > 0)
    out = points.drop_columns(["__level", "__cell"]).take(pa.array(held))
    found = (("n", n[held]), ("first_start", at[np.searchsorted(ends, p[held], "left")]), ("last_end", ends[upto[held] - 1]))
    for name, column in found:
        out = out.append_column(name, pa.array(column, pa.int64()))
    return out


def interval_totals(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, bits: int = CELL_BITS) -> DataFrame:
    """points with n, first_start and last_end: how many ranges of their keys hold them, ends included, the least start and
    the greatest end of these; points that no range holds are left out.

    No point meets a range.  A range lies in two cells at most, of a size that goes with its length; a cell has a row for each
    number at which ranges begin or end and each number that is asked for, so it is bounded however many of them there are."""
    first, last, p = col(start).cast("long"), col(end).cast("long"), col(point).cast("long")
    level = F.greatest(F.lit(0), F.ceil((F.length(F.bin(last - first)) - bits) / MORE_BITS)).cast("int")
    sized = ranges.where(first <= last).select(*on, first.alias("__first"), last.alias("__end"), level.alias("__level"))
    levels = sorted(r[0] for r in sized.select("__level").distinct().collect())
    shift = lambda c: F.call_function("shiftright", c, F.lit(bits) + F.lit(MORE_BITS) * F.col("__level"))
    celled = sized.withColumn("__cell", F.explode(F.sequence(shift(F.col("__first")), shift(F.col("__end")))))
    mark = lambda at, begin, over, until: F.struct(at.alias("at"), F.lit(begin).cast("long").alias("begin"), F.lit(over).cast("long").alias("over"), until.alias("last"))
    none = F.lit(-(1 << 63)).cast("long")
    events = celled.select(*on, "__level", "__cell", F.explode(F.array(mark(F.col("__first"), 1, 0, F.col("__end")), mark(F.col("__end"), 0, 1, none))).alias("e"))
    events = events.groupBy(*on, "__level", "__cell", F.col("e.at").alias("__at")).agg(F.sum("e.begin").alias("__begin"), F.sum("e.over").alias("__over"), F.max("e.last").alias("__last"))
    asked = points.select(*on, p.alias("__point")).where("__point is not null").distinct()
    asked = asked.withColumn("__level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("__cell", shift(F.col("__point")))
    keys = [*on, "__level", "__cell"]
    shape = T.StructType([*(points.schema[k] for k in on), *T.StructType.fromDDL("__point long, n long, first_start long, last_end long").fields])
    met = asked.groupBy(*keys).cogroup(events.groupBy(*keys)).applyInArrow(lambda a, b: _totals(a, b), shape)
    found = met.groupBy(*on, "__point").agg(F.sum("n").alias("n"), F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end"))
    return points.withColumn("__point", p).join(found, [*on, "__point"]).drop("__point")
