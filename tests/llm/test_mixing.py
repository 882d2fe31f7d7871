from collections import defaultdict
from hashlib import md5

from helpers import docs, oracle, same
from pyspark.sql import functions as F

from tracemill.llm import mixing as M


def test_oracle(spark, sf_small):
    same(M.op7_mixing(spark, sf_small).toPandas(), oracle(M.ORACLE, sf_small))


def test_oracle_of_a_tight_mix(spark, sf_small):
    mix = M.Mix(percent=250, max_epochs=3, weights={"domain": {"web": 1, "forum": 0}, "lang": {"de": 9}, "source": {"src2": 50}})
    table = spark.read.parquet(f"{sf_small}/documents.parquet")
    same(M.mixed(table, mix).toPandas(), oracle(M.oracle(mix), sf_small))


def test_shortages_go_to_siblings_first(spark):
    """b1 cannot take its share; b2 gets it, and the other domain nothing."""
    rows = [("a", "x", "a1", 1000), ("b", "x", "b1", 10), ("b", "x", "b2", 1000)]
    nodes = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    mix = M.Mix(weights={}, max_epochs=1, percent=50)
    found = {r.source: r.budget for r in M.leaf_budgets(nodes, mix).collect()}
    assert found == {"a1": 502, "b1": 10, "b2": 492}
    # all of b is short: the rest goes to a
    nodes = spark.createDataFrame([("a", "x", "a1", 1000), ("b", "x", "b1", 10), ("b", "x", "b2", 20)], nodes.schema)
    assert {r.source: r.budget for r in M.leaf_budgets(nodes, mix).collect()} == {"a1": 485, "b1": 10, "b2": 20}


def test_prefix_of_seeded_epochs(spark):
    data = [(i, "w " * (i % 7 + 1)) for i in range(200)]
    table = docs(spark, *data, extra=True).withColumn("lang", F.lit("en")).withColumn("source", F.lit("src1"))
    mix = M.Mix(percent=130, seed=3)
    rows = {r.doc_id: r.copies for r in M.mixed(table, mix).collect()}
    size = sum(len(t.split()) for _, t in data)
    rest, taken, more = size * 130 // 100 - size, 0, set()
    for i, t in sorted(data, key=lambda d: md5(f"3:1:{d[0]}".encode()).hexdigest()):
        taken += len(t.split())
        if taken > rest:
            break
        more.add(i)
    assert rows == {i: 1 + (i in more) for i, _ in data}


def test_edges(spark):
    data = [(1, None), (None, "a b"), (2, ""), (3, "c " * 100_000), (3, "c " * 100_000), (4, "x")]
    rows = M.mixed(docs(spark, *data, extra=True), M.Mix(percent=100)).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.doc_id] += r.tokens * r.copies
    assert sum(held.values()) <= 200_003
    assert M.mixed(docs(spark, (1, "a")).limit(0)).collect() == []
