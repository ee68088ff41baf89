"""Joins by time against every pair, on few rows; their plans have no nested loops, and a hot key is cut up."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import timejoins as J

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def sides(seed, n=300):
    r = random.Random(seed)
    key = lambda: r.choice([1, 1, 1, 2, 3, None])
    left = [(key(), at(r.choice([None, r.randrange(60), r.randrange(100_000)])), k) for k in range(n)]
    right = [(key(), at(r.choice([None, r.randrange(60), r.randrange(100_000)])), r.choice([None, k % 50]), f"v{k}") for k in range(n // 2)]
    return left + left[:10], right + right[:10]


def frames(spark, left, right):
    return spark.createDataFrame(left, "k long, t timestamp, id long").repartition(3), spark.createDataFrame(right, "k long, s timestamp, o long, v string").repartition(3)


@pytest.mark.parametrize("slices", [7, J.SLICE])
def test_as_of(spark, slices):
    left, right = sides(1)
    got = sorted(((tuple(r.left), tuple(r.right) if r.right else None) for r in J.as_of(*frames(spark, left, right), "k", "t", "s", ["o", "v"], slices).collect()), key=str)
    want = []
    for k, t, i in left:
        before = [x for x in right if x[0] is not None and x[0] == k and x[1] is not None and t is not None and x[1] <= t]
        want.append(((k, t, i), max(before, key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[3]), default=None)))
    assert got == sorted(want, key=str) and any(r for _, r in want) and any(not r for _, r in want)


def test_as_of_odd_tables(spark):
    left, right = frames(spark, [(1, at(5), 1)], [(1, at(5), 1, "same"), (1, at(5), None, "less")])
    assert [r.right.v for r in J.as_of(left, right, "k", "t", "s", ["o"]).collect()] == ["same"]
    assert [r.right for r in J.as_of(left, right.limit(0), "k", "t", "s", ["o"]).collect()] == [None]
    assert J.as_of(left.limit(0), right, "k", "t", "s", ["o"]).count() == 0


def test_hot_key_goes_to_many_slices(spark):
    left = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), "id")
    right = left.where("id % 7 = 0").select("k", F.col("t").alias("s"), F.col("id").alias("o"))
    out = J.as_of(left, right, "k", "t", "s", ["o"], 100)
    assert out.where("right.o != floor(left.id / 7) * 7").count() == 0 and out.count() == 4000
    spread = out.select("left.t").count()
    assert spread == 4000


def ranged(seed, n=200):
    r = random.Random(seed)
    points = [(r.choice([1, 1, 1, 2, None]), at(r.choice([None, r.randrange(200_000)])), k) for k in range(n)]
    ranges = []
    for k in range(n // 2):
        start = r.randrange(200_000)
        length = r.choice([0, 1, 30, 60, 59, 600, 100_000, -5, None])
        ranges.append((r.choice([1, 1, 2, 3, None]), at(r.choice([start, start, start, None])), at(None if length is None else start + length), f"r{k}"))
    return points, ranges


@pytest.mark.parametrize("cell, factor", [(60_000_000, 2), (J.CELL, J.FACTOR)])
def test_within(spark, cell, factor):
    points, ranges = ranged(2)
    p = spark.createDataFrame(points, "k long, t timestamp, id long").repartition(3)
    r = spark.createDataFrame(ranges, "k long, a timestamp, b timestamp, v string").repartition(3)
    got = sorted(((x.point.id, x.range.v, x.range.b) for x in J.within(p, r, "k", "t", "a", "b", cell, factor).collect()), key=str)
    want = sorted(((i, v, b) for k, t, i in points for q, a, b, v in ranges if k is not None and k == q and t is not None and a is not None and a <= t and (b is None or t < b)), key=str)
    assert got == want and want
    assert J.within(p, r.limit(0), "k", "t", "a", "b").count() == 0 and J.within(p.limit(0), r, "k", "t", "a", "b").count() == 0


def test_cells_of_long_ranges(spark):
    """However long a range is, it has a few copies."""
    lengths = [1, 59, 60, 61, 1000, 10**5, 10**7]
    rows = spark.createDataFrame([(1, at(0), at(n), n) for n in lengths], "k long, a timestamp, b timestamp, n long")
    out = {r.level: r for r in J.cells(rows, "k", "a", "b", 60_000_000, 16).collect()}
    assert sum(r.ranges for r in out.values()) == len(lengths) and all(r.copies <= 17 * r.ranges for r in out.values()) and max(out) == 5


def test_plans(spark):
    left, right = sides(1)
    points, ranges = ranged(2)
    p = spark.createDataFrame(points, "k long, t timestamp, id long")
    r = spark.createDataFrame(ranges, "k long, a timestamp, b timestamp, v string")
    for frame in (J.as_of(*frames(spark, left, right), "k", "t", "s", ["o"]), J.within(p, r, "k", "t", "a", "b")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
