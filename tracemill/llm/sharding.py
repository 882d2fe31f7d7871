"""Sharding by sampled splitters, in DataFrame functions only: shards of near equal bytes.

Records are ordered by a key (the MD5 of the text, the id), so equal texts lie side by side.  The
order is cut into ranges: a sample in which a record's chance grows with its size (and, so that a mass
of tiny records is cut too, a little with their number) is put in order within each range, and its
quantiles are the boundaries of ``FAN`` smaller ranges.  Ranges of more than ``range_rows`` rows are
subdivided again, by a new sample of their own, until none is overfull.  Then rows are ordered within
their ranges, each a task, and with the totals of the ranges before it every row knows how many bytes
and rows precede it.  A record goes to the shard in which its middle byte falls, so a shard's bytes
differ from an equal share by no more than one record.  A shard's slots count its records in order.

Sampling decides only how evenly the tasks are loaded: shards and slots are those of the whole order,
whatever the samples, files and partitions.  A text with a third of all copies is cut by ids, and
repeated rows of one id by the place at which they were read.  The texts themselves are read once, and
only key, size and checksum are shuffled.

Nulls: a null text has no bytes, a null id comes before all ids.  Ties: rows equal in text and id are
the same record to the result, whichever comes first.  Sizes are the text's UTF-8 bytes plus one, so
empty texts count.  A text larger than a shard's share fills its shard alone, and others may stay
empty.  Columns are selected by name, so extra ones may have any name.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Workspace, table, unused

#: Smaller ranges that a range is cut into, and sampled records for each of them, about.
FAN, SAMPLED = 64, 16
#: Rows of a range that one task puts in order.
RANGE_ROWS = 1_000_000
#: What is known of so many ranges is broadcast (boundaries: 64 keys of 40 bytes each, some 30 MB); beyond, joined by merge.
BROADCAST_RANGES = 10_000


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32`` and the key: ``digest``, ``doc_id`` and ``row``, where it was read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"),
        F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("range"),
    )


def _key() -> Column:
    return F.struct("digest", "doc_id", "row")


def _joined(rows: DataFrame, ranges: DataFrame, count: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(ranges) if count <= BROADCAST_RANGES else ranges.hint("merge"), "range", how)


def splitters(rows: DataFrame, overfull: DataFrame, count: int, seed: int) -> DataFrame:
    """For each range in ``overfull`` (with its ``n`` rows and ``b`` bytes), up to FAN - 1 ``bounds``."""
    drawn = F.pmod(F.xxhash64("digest", "doc_id", "row", F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chance = (F.col("size") / F.col("b") + F.lit(1.0) / F.col("n")) * F.lit(FAN * SAMPLED / 2)
    sample = _joined(rows, overfull, count).where(drawn < chance)
    # a record that is sure to be drawn stands for as many as its size would draw
    sample = sample.select("range", _key().alias("key"), F.greatest(chance.cast("long"), F.lit(1)).alias("weight"))
    own = W.partitionBy("range")
    upto = F.sum("weight").over(own.orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    sample = sample.select("*", upto.alias("upto"), F.sum("weight").over(own).alias("all"))
    share = lambda c: F.floor(c * F.lit(FAN) / F.col("all"))
    ends = sample.where((share(F.col("upto")) > share(F.col("upto") - F.col("weight"))) & (F.col("upto") < F.col("all")))
    return ends.groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("bounds"))


def _child(bounds: Column, key: Column) -> Column:
    """How many bounds are smaller than the key, by halving."""
    steps, step = [], FAN // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    return F.aggregate(
        F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < key, at + step).otherwise(at)
    )


def ranged(rows: DataFrame, space: Workspace, range_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows cut into ranges in the order of their keys, the ranges' totals, and how many ranges there are."""
    level, name = 0, "records-0"
    rows = space.save(rows, name)
    while True:
        totals = space.save(rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")), f"totals-{level}")
        # the first cut is for all, so that no task has to put a small table in order alone
        over = totals.where(F.col("n") > (range_rows if level else 1))
        seen = totals.agg(F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("n") > (range_rows if level else 1)).alias("over")).first()
        if not seen.over:
            return rows, totals, seen.ranges
        bounds = space.save(splitters(rows, over, seen.over, level), f"bounds-{level}")
        wide = _joined(rows, bounds, seen.over, "left")
        cut = F.coalesce(_child(F.col("bounds"), _key()), F.lit(0)).cast("long")
        level += 1
        rows = space.save(wide.withColumn("range", F.col("range") * FAN + cut).drop("bounds"), f"records-{level}")
        space.drop(name)
        name = f"records-{level}"


def placed(docs: DataFrame, shards: int = 8, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, the key's ``digest``, and each record's ``shard`` and ``slot`` in it."""
    space = Workspace(docs.sparkSession, "sharding")
    rows, totals, count = ranged(records(docs, id_col, text_col), space, range_rows)
    # one task sums the totals of ranges, not rows
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy(F.lit(0))
    totals = totals.select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.sum("b").over(all_).alias("bytes"),
    )
    order = W.partitionBy("range").orderBy("digest", "doc_id", "row")
    rows = rows.select(
        "*", F.row_number().over(order).alias("nth"),
        F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"),
    )
    middle = (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size")
    shard = F.least(F.lit(shards - 1).cast("long"), F.expr(f"({shards} * middle) div (2 * bytes)"))
    rows = _joined(rows, totals, count).withColumn("middle", middle).withColumn("shard", shard.cast("int"))
    rows = rows.withColumn("nth", F.col("rows_before") + F.col("nth"))
    rows = space.save(rows.select("doc_id", "size", "text_crc32", "digest", "shard", "nth"), "placed")
    first = rows.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    rows = rows.join(F.broadcast(first), "shard")
    return rows.select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All columns of ``docs`` as Parquet in folders ``shard=0`` and so on, in the order of the key.

    Whole records are range-partitioned once, by the shards' first keys; a range is a file.  (Rows that repeat
    an id and its text all go where the first of them belongs.)
    """
    space = Workspace(docs.sparkSession, "shard-cuts")
    at = placed(docs, shards, range_rows, id_col, text_col)
    cuts = at.groupBy("shard").agg(F.min(F.struct("digest", "doc_id")).alias("cut"))
    cuts = space.save(cuts.agg(F.array_sort(F.collect_list(F.struct("cut", "shard"))).alias("cuts")), "cuts")  # one row
    shard, digest, held = (unused(docs, n) for n in ("shard", "__tm_digest", "__tm_cuts"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wide = docs.withColumn(digest, F.unhex(F.md5(text))).crossJoin(F.broadcast(cuts.select(F.col("cuts").alias(held))))
    key = F.struct(F.col(digest).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
    own = F.array_max(F.transform(F.filter(held, lambda c: c["cut"] <= key), lambda c: c["shard"]))
    wide = wide.withColumn(shard, own).drop(held).repartitionByRange(shard, digest, id_col)
    wide.sortWithinPartitions(shard, digest, id_col).drop(digest).write.partitionBy(shard).parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _crc_table() -> str:
    """The 256 remainders of the reflected polynomial, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return ", ".join(out)


def crc32_sql(bytes_list: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a list of bytes; ``crc`` must be a table of one row with the list ``t``."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


CRC = f"crc AS (SELECT [{_crc_table()}]::BIGINT[] AS t)"


def bytes_sql(text: str) -> str:
    digit = "instr('0123456789ABCDEF', {}) - 1"
    high, low = digit.format("x[1]"), digit.format("x[2]")
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(16 * ({high}) + {low} AS BIGINT))"


ORACLE = f"""
WITH {CRC},
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
o AS (SELECT doc_id, size, md5(text) AS digest, CAST({crc32_sql(bytes_sql('text'))} AS BIGINT) AS text_crc32 FROM d, crc),
p AS (SELECT *, row_number() OVER w AS nth, sum(size) OVER w AS upto, sum(size) OVER () AS bytes FROM o
  WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CAST(least(7, (8 * (2 * upto - size)) // (2 * bytes)) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
