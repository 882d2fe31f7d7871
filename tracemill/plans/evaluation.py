"""Evaluation runs: answers from an injected model, parsed and kept, with what is missing asked again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import scoring, stats
from tracemill.sources.records import read_lines, replace_records
from tracemill.workspace import exists

KEY = ["subset", "sample_idx"]
RESULT = "subset string, sample_idx long, gold string, predicted string, is_correct boolean, output string"


def evaluate(spark: SparkSession, path: str, items: DataFrame, generate: scoring.Scorer, lenient: bool = True) -> DataFrame:
    """All results of ``items`` (subset, sample_idx, gold, prompt), old and new; new ones are appended to ``path``.

    ``generate`` returns ``output``.  A failed call leaves no result, so the item is asked again by the next run.
    """
    old = read_lines(spark, path, RESULT, tolerant=True) if exists(spark, path) else None
    todo = items if old is None else scoring.pending(items, old, KEY)
    answers = scoring.scored(todo, generate, "output string").where("error IS NULL")
    parse = X.parse_answer_lenient if lenient else X.parse_answer
    found = answers.withColumn("predicted", parse(F.col("output")))
    right = F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False))
    found.select(*KEY, "gold", "predicted", right.alias("is_correct"), "output").write.mode("append").json(path)
    return read_lines(spark, path, RESULT, tolerant=True)


def summary(results: DataFrame) -> DataFrame:
    """Rows, right and unparsed ones and accuracy by subset and in all."""
    return stats.evaluation_summary(results)


def rescore(spark: SparkSession, path: str) -> dict[str, int]:
    """Parse the outputs of a file of results again, in its place, and say what changed."""
    rows = read_lines(spark, path, RESULT, tolerant=True)
    new = X.parse_answer_lenient(F.col("output"))
    delta = rows.agg(*stats.rescore_delta(F.col("predicted"), new, F.col("gold"))).first().asDict()
    right = F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False))
    replace_records(rows.withColumn("predicted", new).withColumn("is_correct", right), path)
    return delta
