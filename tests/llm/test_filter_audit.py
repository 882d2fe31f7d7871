import re
from collections import Counter
from itertools import permutations

import pandas as pd
import pytest
from helpers import docs, oracle, rows, same
from pyspark.sql import functions as F

from tracemill.llm import filter_audit as A


def brute(data, labels):
    """Every order applied to lists of documents, one filter after another."""
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }

    flags = [(i, p or "", fails(i, t)) for i, t, p in data]
    out, by_filter = {}, Counter()
    for part in {p for _, p, _ in flags}:
        for order in map("".join, permutations("ABCDE")):
            there = [(i, f) for i, p, f in flags if p == part]
            everything = there
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in there if f[name]]
                there = [(i, f) for i, f in there if not f[name]]
                failing = sum(f[name] for _, f in everything)
                out[part, order, step] = [
                    len(there), len(gone), failing - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in everything),
                    sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone),
                ]
                by_filter[part, name] += len(gone)
    return sorted((*k, *v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items())


OUT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(frame):
    return sorted(tuple(r) for r in frame.select(*OUT).collect())


LABELS = "doc_id long, quality int, toxic int"
PLAIN = " ".join(f"w{i}" for i in range(60))
DATA = [
    (5, PLAIN, "src0"), (3, PLAIN, "src1"), (3, PLAIN, "src1"), (9, PLAIN, None), (None, PLAIN, "src0"),
    (1, None, "src0"), (2, "", "src0"), (4, "one two # three", ""), (6, "SHOUT " * 70, "src0"), (7, "a b " * 40, "src1"),
    (8, PLAIN + " |", "src1"), (10, "Straße " * 3 + "É À Z", "src2"), (11, "x" * 300_000 + " y" * 100_000, "src2"),
]


def table(spark, data):
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    return frame.withColumns({n: F.lit("x") for n in ("part", "digest", "A", "fails", "steps", "own", "step", "first", "good", "n", "words")})


def test_oracle(spark, sf_small):
    same(A.op11_filter_audit(spark, sf_small).toPandas(), oracle(A.ORACLE, sf_small))


def test_brute_force_with_nulls_ties_and_clashing_columns(spark):
    labels = [(5, 1, 0), (9, 0, 1), (9, None, None), (6, 0, 1), (3, 1, 1), (3, 1, 1), (None, 1, 1), (99, 1, 1)]
    got = A.audit(table(spark, DATA), spark.createDataFrame(labels, LABELS))
    assert found(got) == brute(DATA, labels)
    assert got.count() == 4 * 120 * 5


def test_oracle_takes_nulls_and_ties_alike(spark, sf_small):
    frame = pd.DataFrame([(i, t, s) for i, t, s in DATA], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    assert rows(A.audit(table(spark, DATA), labels).toPandas()) == rows(oracle(A.ORACLE, sf_small, frame))


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(docs(spark, (1, "a")).limit(0), none).collect() == []
    got = A.audit(docs(spark, (1, "a")), none)
    assert got.count() == 600 and {(r.good_lost, r.toxic_lost) for r in got.collect()} == {(0, 0)}


def test_any_filters_and_a_hot_part(spark):
    """Three filters of one's own; half the rows are one part, and no task gets more rows than there are counts."""
    flags = spark.range(3000).select(
        F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("p"), F.pmod("id", F.lit(5)))).alias("part"),
        (F.col("id") % 2 == 0).alias("X"), (F.col("id") % 3 == 0).alias("Y"), F.lit(None).cast("boolean").alias("Z"),
    )
    got = {(r.part, r.filter_order, r.step): r for r in A.replay(flags, "XYZ").collect()}
    assert len(got) == 6 * 6 * 3
    assert [got["hot", "XYZ", i].removed for i in (1, 2, 3)] == [750, 250, 0]
    assert [got["hot", "YXZ", i].removed for i in (1, 2, 3)] == [500, 500, 0]
    assert got["hot", "XYZ", 1].unique_fails == 500 and got["hot", "XYZ", 2].redundant == 250
    assert got["hot", "XYZ", 1].shapley == 3 * 750 + 3 * 500
    with pytest.raises(ValueError):
        A.orders(spark, "ABCDEFGHI")
