"""As-of joins, overlaps and sessions against plain loops, with hot keys, ties and nulls."""

import re
from random import Random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import ranges, temporal

SCHEMA = "user long, at long, id long"


def events(n, seed, users=6, hot=None):
    draw = Random(seed)
    user = lambda: hot if hot is not None and draw.random() < 0.5 else draw.choice([*range(users), None])
    return [(user(), draw.choice([draw.randint(0, 200), draw.randint(0, 200), None]), i) for i in range(n)]


def asof(left, right, strict):
    out = []
    for u, t, i in left:
        there = [(x, j) for v, x, j in right if None not in (u, t, v, x) and u == v and (x < t or not strict and x == t)]
        out.append((i, max(there)[1] if there else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_asof(spark, strict, rows):
    left, right = events(150, 1, hot=2), events(120, 2, hot=2)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumn("_row", F.lit(1))
    got = temporal.asof_join(a, b, [("user", "user")], ("at", "at"), {"found": "id", "when": "at"}, ("id",), strict, rows)
    assert got.columns == ["user", "at", "id", "found", "when"]
    assert sorted((r.id, r.found) for r in got.collect()) == asof(left, right, strict)


def test_asof_of_empty_sides(spark):
    a = spark.createDataFrame([(1, 5, 0)], SCHEMA)
    on = ([("user", "user")], ("at", "at"), {"found": "id"})
    assert temporal.asof_join(a, a.limit(0), *on).collect() == [(1, 5, 0, None)]
    assert temporal.asof_join(a.limit(0), a, *on).collect() == []
    with pytest.raises(ValueError):
        temporal.asof_join(a, a, [("user", "user")], ("at", "at"), {"id": "id"})


def test_a_hot_key_is_cut(spark):
    """One user holds half of all events; no key and range has more than twice the median rows of that user's."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("user"), (F.col("id") * F.col("id") % 99991).alias("at"))
    upper = ranges.bounds(rows, "at", 1000)
    counts = rows.withColumn("r", ranges.range_of(F.col("at"), upper)).where("user = 7").groupBy("r").count()
    seen = sorted(r["count"] for r in counts.collect())
    assert len(seen) == 40 and seen[-1] <= 2 * seen[len(seen) // 2]


def test_ranges_are_those_of_bisection(spark):
    from bisect import bisect_left

    upper = [-5, 0, 1, 7, 100, 101, 4000]
    values = [-10, -5, -4, 0, 1, 2, 7, 8, 100, 101, 102, 4000, 4001]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = rows.select("v", ranges.range_of(F.col("v"), upper).alias("r")).collect()
    assert {r.v: r.r for r in got} == {v: bisect_left(upper, v) for v in values}
    assert ranges.bounds(rows.limit(0), "v") == []


def spans(n, seed):
    draw, out = Random(seed), []
    for i in range(n):
        start = draw.randint(-10**9, 10**12)
        length = draw.choice([0, draw.randint(0, 10**9), draw.randint(0, 10**11), 10**14, -5])
        out.append((draw.choice([1, 1, 1, 2, None]), draw.choice([start, start, start, None]), start + length, i))
    return out


def test_intervals(spark):
    left, right = spans(120, 3), spans(110, 4)
    schema = "k long, s long, e long, id long"
    met = temporal.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), [("k", "k")], ("s", "e"), ("s", "e"))
    got = sorted((r.left.id, r.right.id) for r in met.collect())
    known = lambda r: None not in r and r[1] <= r[2]
    want = sorted((a[3], b[3]) for a in left for b in right if known(a) and known(b) and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert got == want and len(got) > 500
    plan = met._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_a_long_interval_stands_in_few_buckets(spark):
    """A thousand years against instants: the long row is there twice a level at most, whatever its length."""
    long = spark.createDataFrame([(1, 0, 1000 * 365 * 86_400 * 1_000_000, 0)], "k long, s long, e long, id long")
    points = spark.range(500).select(F.lit(1).cast("long").alias("k"), (F.col("id") * 3_600_000_000).alias("s"), "id")
    placed = temporal._placed(temporal._spans(long, ["k"], ("s", "e"), "left"), [0], "a")
    assert placed.count() <= 2
    met = temporal.interval_join(long, points, [("k", "k")], ("s", "e"), ("s", "s"))
    assert met.count() == 500 and met.select("right.id").distinct().count() == 500


@pytest.mark.parametrize("rows", [1_000_000, 9])
def test_sessions(spark, rows):
    data = events(300, 5, hot=1) + [(9, 10, 1000), (9, 15, 1001), (9, 21, 1002), (9, 25, 1003)]
    got = temporal.session_starts(spark.createDataFrame(data, SCHEMA), ["user"], "at", 5, rows).collect()
    want, by = {}, {}
    for u, t, i in sorted((d for d in data if d[1] is not None), key=lambda d: d[1]):
        start, last = by.get(u, (t, None))
        if last is None or t - last > 5:
            start = t
        by[u] = (start, t)
        want[i] = start
    assert {r.id: r.session_start for r in got} == want and len(got) == len(want)
    assert want[1001] == 10 and want[1002] == want[1003] == 21
