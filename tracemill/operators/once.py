"""Columns that are evaluated once, and running sums that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that each row evaluates once, however often and in whatever filter they are read.

    The optimiser would copy their expressions to each place that reads them and push them into filters;
    it does neither through a generator of one row.
    """
    rows = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", rows)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that each row evaluates once, and none of which is evaluated where nothing reads it.

    The condition always holds.  Because it counts rows, the optimiser neither copies the column to where it is read
    nor pushes filters on it below; unlike a generator's columns it may still drop it.
    """
    return df.withColumns({n: F.when(F.monotonically_increasing_id() >= 0, c) for n, c in columns.items()})


def running(hist: DataFrame, value: str, sums: dict[str, Column], parts: int = 64) -> DataFrame:
    """``hist``, one row per value, with sums up to each row (``name``) and over all (``name_all``).

    Values are cut into stretches of about equal numbers of rows; sums run within a stretch, and only the
    totals of stretches, ``parts`` of them, are summed in one task.
    """
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    bounds = hist.agg(F.percentile_approx(value, shares, F.lit(1000)).alias("_bounds"))  # one row
    part = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    rows = hist.select("*", *(c.alias(f"_{n}") for n, c in sums.items())).crossJoin(F.broadcast(bounds))
    rows = rows.withColumn("_part", part).drop("_bounds")
    totals = rows.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    before, all_ = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    zero = F.lit(0)
    totals = totals.select(
        "_part", *(F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_b_{n}") for n in sums),
        *(F.sum(f"_t_{n}").over(all_).alias(f"{n}_all") for n in sums),
    )
    upto = W.partitionBy("_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", *(F.sum(f"_{n}").over(upto).alias(f"_u_{n}") for n in sums))
    rows = rows.join(F.broadcast(totals), "_part")
    return rows.select(
        *hist.columns, *((F.col(f"_b_{n}") + F.col(f"_u_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums)
    )


#: Ranges that an order is cut into, and sampled values for each; the bounds are one broadcast row.
RANGES, SAMPLED = 512, 16


def in_ranges(df: DataFrame, name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``, a number that rises with ``name``, about as many rows in each; equal values share one.

    The bounds are quantiles of a sample by hash, of about ``SAMPLED`` values for each range whatever the size of
    ``df``.  Nulls come first.  Nothing runs while the plan is built.
    """
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.pmod(F.xxhash64(name), F.greatest(F.expr(f"_n div {ranges * SAMPLED}"), F.lit(1))) == 0
    sample = df.crossJoin(F.broadcast(size)).where(drawn).agg(F.array_sort(F.collect_set(name)).alias("_v"))
    step = F.greatest(F.expr(f"size(_v) div {ranges}"), F.lit(1))
    bounds = sample.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("_v", i * step - 1)).alias("_bounds"))
    steps = [F.lit(1 << i) for i in reversed(range((ranges - 1).bit_length()))]
    below = lambda at, s: F.when(F.get("_bounds", at + s - 1) < F.col(name), at + s).otherwise(at)
    return df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.aggregate(F.array(*steps), F.lit(0), below)).drop("_bounds")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of its group; a group's ranges are numbered apart.

    Ranges are those of the first column of the order; a task sees one group's rows of one range.
    """
    rows = in_ranges(df, order[0], ranges)
    key = [*by, "_range"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(key)), F.coalesce(upto, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    rows = rows.withColumn("_own", own)
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & rows[c].eqNullSafe(counts[f"_key{i}"])
    rows = rows.join(counts, same).withColumn(name, (F.col("_before") + F.col("_own")).cast("long"))
    return rows.drop("_range", "_own", "_before", *(f"_key{i}" for i in range(len(key))))


def first_ids(pool: DataFrame, size: DataFrame, lead: Column, order: str, *more: str) -> DataFrame:
    """``id`` of the first ``n`` rows of ``pool`` (``size`` is one row, ``n``), ordered by ``lead``, ``order`` and ``more``.

    Rows are counted by ``lead``, and groups that fit are taken whole.  The group in which the n-th row lies is
    counted by ranges of ``order`` in the same way, and only the last range is put in order.
    """
    pool = pool.withColumn("_lead", lead)
    each = running(pool.groupBy("_lead").agg(F.count(F.lit(1)).alias("_c")), "_lead", {"upto": F.col("_c")})
    each = each.crossJoin(F.broadcast(size.select(F.col("n").alias("_n")))).where("upto - _c < _n")
    rows = pool.join(each.select("_lead", (F.col("_n") - F.col("upto") + F.col("_c")).alias("_room"), "_c"), "_lead")
    edge = in_ranges(rows.where("_room < _c").drop("_c"), order)
    counts = edge.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))  # a row for each range
    upto = F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    edge = edge.join(F.broadcast(counts.select("_range", "_c", F.coalesce(upto, F.lit(0)).alias("_before"))), "_range")
    whole = edge.where("_before + _c <= _room")
    last = edge.where("_before < _room AND _before + _c > _room")
    last = last.withColumn("_r", F.row_number().over(W.partitionBy("_range").orderBy(order, *more))).where("_before + _r <= _room")
    return rows.where("_room >= _c").select("id").unionByName(whole.select("id")).unionByName(last.select("id"))


def first_by_hash(pool: DataFrame, size: DataFrame) -> DataFrame:
    """``id`` of the first ``n`` rows (``size`` is one row, ``n``) in the order of ``h``, a hash as hexadecimal text, then ``id``.

    Rows are counted in the 4096 stretches of the hash's first three digits, and only the stretch in which the n-th
    row lies is put in order.
    """
    rows = pool.withColumn("_range", F.left("h", F.lit(3)))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))  # 4096 rows at most
    upto = F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("_upto", upto).crossJoin(F.broadcast(size.select(F.col("n").alias("_n")))).where("_upto - _c < _n")
    rows = rows.join(F.broadcast(counts), "_range")
    edge = rows.where("_upto > _n").withColumn("_r", F.row_number().over(W.partitionBy("_range").orderBy("h", "id")))
    return rows.where("_upto <= _n").select("id").unionByName(edge.where("_upto - _c + _r <= _n").select("id"))
