"""Cubes with exact distinct counts, and sketches that are stored and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_distinct(df: DataFrame, dims: list[str], who: Column, **sums: Column) -> DataFrame:
    """All grouping sets of ``dims``: ``level`` (the grouping id: 0 is all dims, a bit is a dim left out), sums, and ``distinct``.

    ``who`` is a whole number; nulls are not counted.  Rows are first reduced to one bitmap of 32 768 numbers for each
    finest cell and bucket of numbers; the sets combine these, so neither rows nor numbers are multiplied by the sets,
    and a cell's numbers are spread over its buckets.  A null dim of a cell is told from a dim left out by ``level``.
    """
    bucket, bits = F.bitmap_bucket_number(who), F.bitmap_construct_agg(F.bitmap_bit_position(who))
    cells = df.groupBy(*dims, bucket.alias("_bucket")).agg(bits.alias("_bits"), *(F.sum(c).alias(n) for n, c in sums.items()))
    sets = [[d for i, d in enumerate(dims) if not mask >> (len(dims) - 1 - i) & 1] for mask in range(2 ** len(dims))]
    merged = cells.groupingSets([[F.col(c) for c in (*s, "_bucket")] for s in sets], *(F.col(c) for c in (*dims, "_bucket")))
    merged = merged.agg(
        F.grouping_id(*dims, "_bucket").alias("_id"), F.bitmap_or_agg("_bits").alias("_bits"), *(F.sum(n).alias(n) for n in sums)
    )
    level = F.shiftright("_id", 1).cast("int")  # the bucket, the last bit, is in every set
    return merged.groupBy(level.alias("level"), *dims).agg(
        F.sum(F.bitmap_count("_bits")).cast("long").alias("distinct"), *(F.sum(n).alias(n) for n in sums)
    )


#: Registers of a distinct count (2**12: a standard error of 1.63 %), size of a quantile sketch (rank error under 1 %),
#: values whose counts a frequency sketch follows.
HLL_LG, KLL_K, TOP_FOLLOWED = 12, 350, 1000


def sketches(df: DataFrame, by: list[str], who: str, value: str, item: str) -> DataFrame:
    """One row per key with ``n`` and sketches of distinct ``who``, quantiles of ``value`` and frequent ``item``: what is stored.

    Sketches are built in the tasks that read the rows, and merged; a key with a third of all rows sends no more than any.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(who, F.lit(HLL_LG)).alias("who"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("value"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {TOP_FOLLOWED})").alias("item"),
    )


def rolled_up(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches merged to fewer keys, without reading the rows again.

    All orders of merging keep the bounds.  Counts of few values are exact in all; a distinct count may differ by
    less than its error, because its estimator knows whether a sketch saw rows or other sketches.
    """
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("value", F.lit(KLL_K)).alias("value"),
        F.expr(f"approx_top_k_combine(item, {TOP_FOLLOWED})").alias("item"),
    )


def estimates(stored: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9), top: int = 5) -> DataFrame:
    """What sketches say: ``distinct``, the values at ``quantiles`` in an array, and the ``top`` items with counts.

    A key whose values are all null has no quantiles; null items are counted as an item.
    """
    at = F.array(*(F.lit(q) for q in quantiles))
    keys = [c for c in stored.columns if c not in ("n", "who", "value", "item")]
    return stored.select(
        *keys, "n", F.hll_sketch_estimate("who").alias("distinct"),
        F.when(F.kll_sketch_get_n_double("value") > 0, F.kll_sketch_get_quantile_double("value", at)).alias("quantiles"),
        F.expr(f"approx_top_k_estimate(item, {top})").alias("top"),
    )
