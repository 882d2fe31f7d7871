"""Ranges of an ordered column that hold about equal numbers of rows: the pieces in which a hot key is worked on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about, and ranges at most: their bounds are a literal of the plan (8 bytes each).
RANGE_ROWS, MOST_RANGES = 1_000_000, 1024


def as_long(df: DataFrame, name: str) -> Column:
    """A time as microseconds (of its own clock, where it has no zone), a date as those of its midnight, a number as it is."""
    kind, at = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    return F.unix_date(at).cast("long") * 86_400_000_000 if isinstance(kind, T.DateType) else at.cast("long")


def bounds(df: DataFrame, name: str, rows: int = RANGE_ROWS) -> list[int]:
    """Upper bounds of all ranges but the last, from one pass over the column; none for a small or empty table."""
    shares = F.lit(np.arange(1, MOST_RANGES) / MOST_RANGES)
    seen = df.agg(F.count(name).alias("n"), F.percentile_approx(name, shares, F.lit(10 * MOST_RANGES)).alias("at")).first()
    ranges = min(MOST_RANGES, -(-seen.n // rows))
    picked = (seen.at[i * MOST_RANGES // ranges - 1] for i in range(1, ranges)) if ranges > 1 else ()
    return sorted(set(picked))


def range_of(value: Column, upper: list[int]) -> Column:
    """The number of bounds below a value, by halving."""
    if not upper:
        return F.lit(0)
    step = 1 << len(upper).bit_length()
    steps = []
    while step := step // 2:
        steps.append(F.lit(step))
    found = F.lit(np.array(upper, dtype=np.int64))
    return F.aggregate(
        F.array(*steps), F.lit(0), lambda at, s: F.when(F.get(found, at + s - 1) < value, at + s).otherwise(at)
    )
