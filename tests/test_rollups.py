"""Cubes, sketches and table functions on small tables."""

import json
from itertools import product
from random import Random

from pyspark.sql import functions as F

from tracemill.functions import tables
from tracemill.operators import rollups


def test_cube_against_sets(spark):
    """Null dims, null and negative numbers, and numbers in many buckets."""
    draw = Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, 2, None]), draw.choice([None, -5, 0, 1, 2, 32768, 32769, 10**12, draw.randint(0, 10**6)])) for _ in range(400)]
    got = rollups.cube_distinct(spark.createDataFrame(rows, "x string, y int, who long"), ["x", "y"], F.col("who"), n=F.lit(1))
    want = {}
    for keep_x, keep_y in product([True, False], repeat=2):
        for x, y, w in rows:
            key = (2 * (not keep_x) + (not keep_y), x if keep_x else None, y if keep_y else None)
            held = want.setdefault(key, [set(), 0])
            held[1] += 1
            if w is not None:
                held[0].add(w)
    found = {(r.level, r.x, r.y): (r["distinct"], r.n) for r in got.collect()}
    assert found == {k: (len(s), n) for k, (s, n) in want.items()}
    assert (1, None, None) in found and (3, None, None) in found  # the null x is a cell of its own beside the total
    assert rollups.cube_distinct(spark.createDataFrame([], "x string, who long"), ["x"], F.col("who")).collect() == []


def events(spark, n):
    rows = spark.range(n).select(
        F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("key"), (F.col("id") % 30).alias("day"),
        (F.hash("id") % 20_000).alias("who"), (F.col("id") * 7919 % n).cast("double").alias("value"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 50)).alias("item"),
    )
    return rows


def test_sketches_keep_their_bounds_in_any_order_of_merging(spark):
    rows = events(spark, 60_000)
    stored = rollups.sketches(rows, ["key", "day"], "who", "value", "item")
    ways = [
        rollups.rolled_up(stored, ["key"]),
        rollups.rolled_up(rollups.rolled_up(stored.withColumn("week", F.floor(F.col("day") / 7)), ["key", "week"]), ["key"]),
        rollups.rolled_up(stored.repartition(7, "day").orderBy(F.desc("day")), ["key"]),
    ]
    exact = {r.key: r for r in rows.groupBy("key").agg(
        F.count_distinct("who").alias("who"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("value")).alias("values"),
        F.count_if(F.col("item") == "hot").alias("hot"),
    ).collect()}
    seen = []
    for way in ways:
        found = {r.key: r for r in rollups.estimates(way, (0.1, 0.5, 0.99), 1).collect()}
        assert set(found) == set(exact)
        for key, r in found.items():
            x = exact[key]
            assert r.n == x.n and abs(r["distinct"] - x.who) <= 0.05 * x.who
            for q, v in zip((0.1, 0.5, 0.99), r.quantiles, strict=True):
                assert abs(sum(1 for y in x["values"] if y <= v) / x.n - q) < 0.015
            assert [(t["item"], t["count"]) for t in r.top] == [("hot", x.hot)]
        seen.append({k: r["distinct"] for k, r in found.items()})
    assert all(abs(a[k] - seen[0][k]) <= 0.02 * seen[0][k] for a in seen for k in a)  # the same registers, another estimator


def test_sketches_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("a", 1, 2.0, "x"), (None, None, None, None)], "key string, who long, value double, item string")
    found = {r.key: r for r in rollups.estimates(rollups.sketches(rows, ["key"], "who", "value", "item")).collect()}
    assert found["a"]["distinct"] == 1 and found["a"].quantiles == [2.0, 2.0] and found["a"].n == 2
    assert found[None]["distinct"] == 0
    assert rollups.sketches(rows.limit(0), ["key"], "who", "value", "item").collect() == []


def test_json_paths(spark):
    deep = {"a": {"b": [1, {"c": None}, "x"]}, "d": True, "e": 1.5, "f": {}, "g": [], "": "q"}
    texts = [json.dumps(deep), None, "", "  ", "{broken", "3", '"text"', "null", "[" * 100_000, json.dumps({"long": "y" * 300_000})]
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").createOrReplaceTempView("texts")
    tables.register(spark)
    rows = spark.sql("SELECT id, p.* FROM texts, LATERAL json_paths(text) p").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.path, r.value))
    assert got.pop(9) == [("long", "y" * 300_000)]
    assert got == {
        0: [("a.b[0]", "1"), ("a.b[1].c", None), ("a.b[2]", "x"), ("d", "true"), ("e", "1.5"), ("", "q")],
        5: [("", "3")], 6: [("", "text")], 7: [("", None)],
    }


def test_event_runs(spark):
    rows = [(1, i, k, i) for i, k in enumerate("aab" + "c" * 25_000 + "a")] + [(None, 7, "z", 1), (None, 8, None, 2), (None, 9, None, 3)]
    spark.createDataFrame(rows, "u long, i long, k string, at long").createOrReplaceTempView("run_rows")
    tables.register(spark)
    sql = "SELECT * FROM event_runs(TABLE(SELECT * FROM run_rows{}) PARTITION BY u ORDER BY at)"
    got = sorted((tuple(r) for r in spark.sql(sql.format("")).collect()), key=repr)
    assert got == sorted([
        (1, 1, "a", 2, 0, 1), (1, 2, "b", 1, 2, 2), (1, 3, "c", 25_000, 3, 25_002), (1, 4, "a", 1, 25_003, 25_003),
        (None, 1, "z", 1, 7, 7), (None, 2, None, 2, 8, 9),
    ], key=repr)
    assert spark.sql(sql.format(" WHERE u = 5")).collect() == []
