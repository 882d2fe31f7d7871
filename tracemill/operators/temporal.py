"""Joins and sessions in time: as-of joins, overlaps of intervals, sessions by gaps.

Keys may be hot: each operator cuts a key's rows into ranges of time and works on a (key, range) at a
time.  What a range needs to know of those before it (the last match, the last time) is handed over in
tables of one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.ranges import RANGE_ROWS, as_long, bounds, range_of


def _all_known(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def asof_join(
    left: DataFrame, right: DataFrame, by: list[tuple[str, str]], on: tuple[str, str], take: dict[str, str],
    tie: tuple[str, ...] = (), strict: bool = False, rows: int = RANGE_ROWS,
) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key at or before its time (before it, if ``strict``).

    ``take`` names the result's columns and where they come from.  Of several rows of ``right`` at one time the one
    greatest by ``tie`` and then by the taken columns is last.  Rows of ``left`` without a match, or with a null key
    or time, stay with nulls; such rows of ``right`` match nothing.  Both sides are put in one order for each key and
    range of time, and the last match is carried forward; no pairs are made.
    """
    if clash := set(take) & set(left.columns):
        raise ValueError(f"the left side has columns {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(by))]
    own = left.select(
        *(F.col(a).alias(k) for (a, _), k in zip(by, keys, strict=True)), as_long(left, on[0]).alias("_t"),
        F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row"),
    )
    found = F.struct(*(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)), *(F.col(c).alias(n) for n, c in take.items()))
    other = right.select(*(F.col(b).alias(k) for (_, b), k in zip(by, keys, strict=True)), as_long(right, on[1]).alias("_t"), found.alias("_found"))
    known = _all_known([*keys, "_t"])
    other = other.where(known)
    kind = other.schema["_found"].dataType
    upper = bounds(own.select("_t").unionAll(other.select("_t")), "_t", rows)
    both = own.where(known).select(*keys, "_t", F.lit(0 if strict else 1).alias("_side"), "_row", F.lit(None).cast(kind).alias("_found"))
    both = both.unionByName(other.select(*keys, "_t", F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), "_found"))
    both = both.withColumn("_range", range_of(F.col("_t"), upper))
    order = W.partitionBy(*keys, "_range").orderBy("_t", "_side", "_found").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_last", F.last("_found", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    if upper:
        ends = both.groupBy(*keys, "_range").agg(F.max(F.when(F.col("_found").isNotNull(), F.struct("_t", "_found"))).alias("_end"))
        before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before)["_found"].alias("_before"))
        out = out.join(ends, [*keys, "_range"]).withColumn("_last", F.coalesce("_last", "_before"))
    out = out.select("_row", "_last").unionByName(own.where(~known).select("_row", F.lit(None).cast(kind).alias("_last")))
    return out.select("_row.*", *(F.col("_last")[n].alias(n) for n in take))


#: Widths of time buckets: level 0, and how many times wider each further level is.  Sixteen levels reach 34 million days.
BASE_MICROS, WIDER, LEVELS = 60_000_000 * 45, 4, 16
_WIDTHS = [BASE_MICROS * WIDER**i for i in range(LEVELS)]


def _spans(df: DataFrame, by: list[str], span: tuple[str, str], side: str) -> DataFrame:
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    out = df.select(*keys, as_long(df, span[0]).alias("_s"), as_long(df, span[1]).alias("_e"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(side))
    out = out.where(_all_known([*(f"_k{i}" for i in range(len(by))), "_s", "_e"]) & (F.col("_s") <= F.col("_e")))
    level = F.size(F.filter(F.array(*(F.lit(w) for w in _WIDTHS[:-1])), lambda w: w < F.col("_e") - F.col("_s")))
    return out.withColumn("_own", level)


def _placed(spans: DataFrame, others: list[int], side: str) -> DataFrame:
    """A row for each bucket that a span touches, two at most, at its own level and at the other side's wider ones."""
    at = F.filter(F.array(*(F.lit(i) for i in range(LEVELS))), lambda i: (i == F.col("_own")) | (i > F.col("_own")) & i.isin(*(others or [-1])))
    out = spans.select("*", F.explode(at).alias("_level"))
    width = F.element_at(F.array(*(F.lit(w) for w in _WIDTHS)), F.col("_level") + 1)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: E731  whole microseconds below 2**53
    out = out.select("*", bucket("_s").alias("_first"), F.explode(F.sequence(bucket("_s"), bucket("_e"))).alias("_bucket"))
    return out.withColumnsRenamed({c: f"{c}_{side}" for c in ("_s", "_e", "_own", "_first")})


def interval_join(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs ``left`` and ``right`` (as structs) of one key whose closed intervals share an instant, each pair once.

    Intervals are put into buckets of a width that fits their length, so however long one is it stands in two
    buckets of a level; two intervals meet at the wider one's level, in the first bucket that both touch.  So a
    long interval multiplies neither rows nor results, and the key's rows are spread over buckets of time.  Nulls
    in key or span, and spans that end before they begin, meet nothing.
    """
    a = _spans(left, [x for x, _ in by], left_span, "left")
    b = _spans(right, [y for _, y in by], right_span, "right")
    used = [sorted(r._own for r in s.select("_own").distinct().collect()) for s in (a, b)]  # sixteen numbers at most
    keys = [f"_k{i}" for i in range(len(by))]
    met = _placed(a, used[1], "a").join(_placed(b, used[0], "b"), [*keys, "_level", "_bucket"])
    met = met.where(F.greatest("_own_a", "_own_b") == F.col("_level"))
    met = met.where(F.col("_bucket") == F.greatest("_first_a", "_first_b"))
    return met.where((F.col("_s_a") <= F.col("_e_b")) & (F.col("_s_b") <= F.col("_e_a"))).select("left", "right")


def session_starts(df: DataFrame, by: list[str], time: str, gap_micros: int, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``session_start``, in microseconds: the first time of a run of rows no more than a gap apart.

    Rows with a null key are a key of their own; rows without a time are in no session and left out.
    """
    rows_in = df.withColumn("_t", as_long(df, time)).where("_t IS NOT NULL")
    upper = bounds(rows_in.select("_t"), "_t", rows)
    rows_in = rows_in.withColumn("_range", range_of(F.col("_t"), upper))
    order = W.partitionBy(*by, "_range").orderBy("_t")
    rows_in = rows_in.withColumn("_prev", F.lag("_t").over(order))
    key = [*by, "_range"]

    def handed(df: DataFrame, column: Column, name: str) -> DataFrame:
        """The last value of a key's ranges before each range, one row for each key and range."""
        before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        ends = df.groupBy(*key).agg(F.max(column).alias("_m"))
        return ends.select(*(F.col(c).alias(f"_h{i}") for i, c in enumerate(key)), F.max("_m").over(before).alias(name))

    def joined(df: DataFrame, ends: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(key):
            same = same & df[c].eqNullSafe(ends[f"_h{i}"])
        return df.join(ends, same).drop(*(f"_h{i}" for i in range(len(key))))

    if upper:
        rows_in = joined(rows_in, handed(rows_in, F.col("_t"), "_carried")).withColumn("_prev", F.coalesce("_prev", "_carried")).drop("_carried")
    start = F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap_micros), F.col("_t"))
    rows_in = rows_in.withColumn("_start", start)
    out = rows_in.withColumn("session_start", F.max("_start").over(order))  # with all rows of the same time
    if upper:
        out = joined(out, handed(rows_in, F.col("_start"), "_carried")).withColumn("session_start", F.coalesce("session_start", "_carried")).drop("_carried")
    return out.drop("_t", "_range", "_prev", "_start")


def sessions(df: DataFrame, by: list[str], time: str, gap_micros: int, rows: int = RANGE_ROWS, **measures: Column) -> DataFrame:
    """One row per key and session: the first and the last time, ``began`` and ``last``, and measures."""
    started = session_starts(df, by, time, gap_micros, rows)
    out = started.groupBy(*by, "session_start").agg(F.min(time).alias("began"), F.max(time).alias("last"), *(c.alias(n) for n, c in measures.items()))
    return out.drop("session_start")
