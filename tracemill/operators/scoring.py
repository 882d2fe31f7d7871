"""External models as injected scorers: what is pending, which results are good, and resuming.

Filters and anti-joins stand before the scorer, because no predicate is pushed through it.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.text import or_empty
from tracemill.session import ship_package

#: Rows of text columns in, one dict of results per row out; raising marks the row as an error.
Scorer = Callable[[dict], dict]


def good_result(row_error: Column, text: Column) -> Column:
    """No error, and a text that is not empty."""
    return (or_empty(row_error) == "") & (or_empty(text) != "")


def good_counterfactuals(items: Column) -> Column:
    """At least one, and each with a text and no error."""
    fine = F.forall(items, lambda c: (or_empty(c["cf_cot"]) != "") & (or_empty(c["error"]) == ""))
    return F.coalesce((F.size(items) > 0) & fine, F.lit(False))


def latest(done: DataFrame, key: list[str], position: str) -> DataFrame:
    """The last row of each key."""
    order = W.partitionBy(*key).orderBy(F.desc(position))
    return done.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pending(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no good result yet."""
    return todo.join(done.select(*key), key, "left_anti")


def done_count(done: DataFrame, key: list[str]) -> DataFrame:
    return done.agg(F.count_distinct(*key).alias("done"))


def scored(rows: DataFrame, scorer: Scorer, schema: str, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows`` with the scorer's fields and ``error``; a task that is run again scores the same rows again."""
    fields = T.StructType.fromDDL(schema)
    names = fields.fieldNames()
    out = T.StructType([*rows.schema.fields, *fields.fields, T.StructField("error", T.StringType())])

    def attempt(row: dict) -> dict:
        failure = ""
        for i in range(tries):
            try:
                return {**dict.fromkeys(names), **scorer(row), "error": None}
            except Exception as e:  # the row's result is the error
                failure = f"{type(e).__name__}: {e}"
                if wait and i + 1 < tries:
                    time.sleep(wait)
        return {**dict.fromkeys(names), "error": failure}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = pd.DataFrame([attempt(r) for r in frame.to_dict("records")], columns=[*names, "error"], index=frame.index)
            yield pd.concat([frame, results], axis=1)

    ship_package(rows.sparkSession)
    return rows.mapInPandas(run, out)


def stub_grade(*parts: object) -> int:
    """A grade from 1 to 5 that depends on the parts only."""
    return 1 + hashlib.md5("\x1f".join(map(str, parts)).encode()).digest()[0] % 5


def stub_judge(column: str) -> Scorer:
    """Stands in for a judge model in tests and examples."""
    return lambda row: {"score": float(stub_grade(row[column])), "raw": f'{{"score": {stub_grade(row[column])}}}'}


def too_many_failures(results: DataFrame, limit: int) -> bool:
    """Whether errors exceed a limit, so that a driver may stop instead of paying for more calls."""
    return results.where("error IS NOT NULL").limit(limit + 1).count() > limit
