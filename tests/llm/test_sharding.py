import zlib
from hashlib import md5

import pytest
from helpers import docs, oracle, same
from pyspark.sql import functions as F

from tracemill.llm import sharding as S


def brute(data, shards=8):
    """Shards and slots by one walk over all records in order."""
    order = sorted(((md5((t or "").encode()).hexdigest(), i is not None, i or 0, t or "") for i, t in data))
    total, before, out, slots = sum(len(t.encode()) + 1 for *_, t in order), 0, [], [0] * shards
    for _, known, i, t in order:
        size = len(t.encode()) + 1
        shard = min(shards - 1, shards * (2 * before + size) // (2 * total))
        out.append((i if known else None, size, zlib.crc32(t.encode()), shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out, key=repr)


def got(frame):
    rows = frame.select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_oracle(spark, sf_small):
    same(S.op13_sharding(spark, sf_small).toPandas(), oracle(S.ORACLE, sf_small))


HOT = [(i, "copy of one text") for i in range(200)] + [(i, f"{i} " * (i % 13) + "é") for i in range(200, 500)]
ODD = [(None, "a"), (1, None), (2, ""), (2, ""), (2, ""), (3, "long " * 50_000), (4, "z"), (4, "z"), (5, "ß" * 1000), (None, None)]


@pytest.mark.parametrize("data", [HOT, ODD, HOT + ODD, [(1, "a")], [(i, "") for i in range(40)]], ids=["hot", "odd", "both", "one", "empty"])
def test_brute_force_and_range_sizes(spark, monkeypatch, data):
    """Small ranges, cut several times over, place records as one range does."""
    table = docs(spark, *data, extra=True).withColumns({n: F.lit("x") for n in ("size", "digest", "range", "shard", "slot", "bounds")})
    want = brute(data)
    assert got(S.placed(table)) == want
    monkeypatch.setattr(S, "FAN", 4)
    assert got(S.placed(table.repartition(5), range_rows=20)) == want


def test_merge_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_RANGES", 0)
    assert got(S.placed(docs(spark, *HOT), shards=3, range_rows=60)) == brute(HOT, 3)


def test_no_range_stays_overfull_and_shards_are_even(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 8)
    data = [(i, "") for i in range(3000)] + [(i, "same text") for i in range(3000, 6000)] + [(i, f"{i} " * (i % 50)) for i in range(6000, 7000)]
    space = S.Workspace(spark, "test-sharding")
    rows, totals, count = S.ranged(S.records(docs(spark, *data)), space, 250)
    assert totals.agg(F.max("n")).first()[0] <= 250 and totals.count() == count and rows.count() == 7000
    out = S.placed(docs(spark, *data), range_rows=250)
    found = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.countDistinct("slot").alias("n")).collect()
    sizes = [r.bytes for r in found]
    assert len(found) == 8 and max(sizes) - min(sizes) <= 2 * max(len(t) + 1 for _, t in data)
    assert all(r["last"] == r.n - 1 for r in found)


def test_empty(spark):
    assert S.placed(docs(spark, (1, "a")).limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    """Folders hold whole rows, each in its shard, in the order of the key."""
    data = [(i, f"text {i} " * (i % 9 + 1)) for i in range(300)] + [(i, "copy") for i in range(300, 400)] + [(None, None), (400, "")]
    table = docs(spark, *data, extra=True)
    S.write_shards(table, str(tmp_path / "out"), shards=4, range_rows=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(table.columns) < set(back.columns)
    found = {(r.doc_id, r.text): r.shard for r in back.collect()}
    want = {(r.doc_id, r.size, r.text_crc32): r.shard for r in S.placed(table, 4).collect()}
    assert len(found) == back.count() == 402
    assert {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): s for (i, t), s in found.items()} == want


def test_native(spark, sf_small):
    plan = S.placed(spark.read.parquet(f"{sf_small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
