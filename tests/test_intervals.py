import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import intervals


def made(seed, points, ranges):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
    p = [(i, key(), rng.randrange(-40, 400)) for i in range(points)] + [(9001, "hot", None), (9002, None, 3), (9003, "none", 3), (9004, "hot", 1 << 40)]
    r = [(i, key(), (s := rng.randrange(-50, 380)), s + rng.choice([-1, 0, 0, 1, 2, 5, 31, 32, 33, 100])) for i in range(ranges)]
    return p, r + [(9001, "hot", None, 5), (9002, "hot", 5, None), (9003, None, 0, 9), (9004, "hot", -(1 << 40), 1 << 41), (9005, "hot", 0, 0), (9005, "hot", 0, 0)]


@pytest.mark.parametrize("together", [0, 20, 10**6])
def test_pairs_are_those_of_all_pairs(spark, together):
    p, r = made(together, 150, 200)
    points = spark.createDataFrame(p, "id long, k string, at long")
    ranges = spark.createDataFrame(r, "rid long, k string, lo long, hi long")
    got = sorted((x.id, x.rid) for x in intervals.interval_join(points, ranges, ["k"], "at", "lo", "hi", together).collect())
    want = sorted((i, j) for i, k, a in p for j, k2, s, e in r if k is not None and k == k2 and None not in (a, s, e) and s <= a <= e)
    assert got == want


def test_segments_cover_their_range_once(spark):
    for s, e in ((0, 0), (3, 3), (0, 63), (1, 62), (-5, 9), (7, 6), (1023, 1025), (-8, -1)):
        cut = spark.range(1).select(intervals.segments(F.lit(s), F.lit(e)).alias("s")).first().s
        assert sorted(n for x in cut for n in range(x["index"] << x.level, (x["index"] + 1) << x.level)) == list(range(s, e + 1))
        assert len(cut) <= 2 * max(1, (e - s + 1).bit_length())


def test_no_ranges_and_no_points(spark):
    points = spark.createDataFrame([(1, "k", 4)], "id long, k string, at long")
    ranges = spark.createDataFrame([], "rid long, k string, lo long, hi long")
    for together in (0, 5):
        assert intervals.interval_join(points, ranges, ["k"], "at", "lo", "hi", together).count() == 0
    assert intervals.segment_join(points, ranges, ["k"], "at", "lo", "hi").count() == 0
    assert intervals.interval_join(points.limit(0), spark.createDataFrame([(1, "k", 0, 9)], ranges.schema), ["k"], "at", "lo", "hi", 0).count() == 0


def test_a_hot_key_is_joined_on_segments(spark):
    p, r = made(3, 400, 400)
    found = intervals.interval_join(spark.createDataFrame(p, "id long, k string, at long"), spark.createDataFrame(r, "rid long, k string, lo long, hi long"), ["k"], "at", "lo", "hi", 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__level" in plan and "Union" in plan


def test_totals_of_ranges_of_all_lengths(spark):
    rng = random.Random(8)
    ranges = [(rng.choice("ab"), a := rng.randrange(-300, 300), a + rng.choice([-1, 0, 1, 7, 40, 700, 20000])) for _ in range(150)] + [("a", 5, None), ("b", None, 9)]
    points = [(i, rng.choice("abc"), rng.randrange(-400, 1500)) for i in range(400)] + [(400, "a", None), (401, "a", 3), (402, "a", 3)]
    want = {}
    for i, k, p in points:
        held = [(a, b) for key, a, b in ranges if key == k and None not in (a, b, p) and a <= p <= b]
        if held:
            want[i] = (len(held), min(a for a, _ in held), max(b for _, b in held))
    for bits in (3, 16):
        got = intervals.interval_totals(spark.createDataFrame(points, "id long, k string, p long"), spark.createDataFrame(ranges, "k string, a long, b long"), ["k"], "p", "a", "b", bits=bits).collect()
        assert {r.id: (r.n, r.first_start, r.last_end) for r in got} == want and len(got) == len(want)


def test_totals_where_every_range_holds_every_point(spark):
    """900 million pairs."""
    n = 30000
    points = spark.range(n).selectExpr("id", "'f' AS k", "50000 + id % 9 AS p")
    ranges = spark.range(n).selectExpr("'f' AS k", "id AS a", "100000 + id AS b")
    assert intervals.interval_totals(points, ranges, ["k"], "p", "a", "b").where(f"n = {n} and first_start = 0 and last_end = {99999 + n}").count() == n


def test_by_some_of_the_keys(spark):
    p, r = made(5, 200, 120)
    points = spark.createDataFrame([(*x, x[0] % 7) for x in p], "id long, file string, p long, c int")
    ranges = spark.createDataFrame([(*x, x[0] % 7) for x in r], "edit long, file string, a long, b long, c int")
    want = sorted((i, e) for i, k, x in p for e, key, a, b in r if None not in (k, key, x, a, b) and k == key and i % 7 == e % 7 and a <= x <= b)
    for together in (5, 20, 1000):
        got = intervals.interval_join(points, ranges, ["c", "file"], "p", "a", "b", together=together, by=["c"])
        assert sorted((x.id, x.edit) for x in got.collect()) == want
