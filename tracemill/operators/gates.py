"""Quality gates as columns: a gate is a verdict, a score and a reason, not a call per row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import RuleGates
from tracemill.functions import text as X
from tracemill.operators.once import pinned
from tracemill.schemas import FILTER_RECORD, GATES


@dataclass(frozen=True)
class Gate:
    name: str
    passed: Column
    score: Column | None = None
    reason: Column | None = None

    def record(self) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(self.name).alias("filter_name"), self.passed.alias("passed"),
            (none if self.score is None else self.score).cast("double").alias("score"),
            (none if self.reason is None else self.reason).cast("string").alias("reason"),
        )


def judged(df: DataFrame, gate: Gate, history: str = "filter_history") -> DataFrame:
    """``df`` with the gate's record appended to the history."""
    old = F.coalesce(F.col(history), F.array().cast(f"array<{FILTER_RECORD}>")) if history in df.columns else None
    new = F.array(gate.record())
    return df.withColumn(history, new if old is None else F.concat(old, new))


def passing(df: DataFrame, gate: Gate, history: str = "filter_history") -> DataFrame:
    """Rows that pass, each with its record."""
    return judged(df, gate, history).where(F.element_at(history, -1)["passed"])


def rejection_rate(df: DataFrame, gate: Gate) -> DataFrame:
    """Rows, rows rejected, and their share (0 without rows)."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(gate.passed, F.lit(False))).alias("rejected"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("rejected") / F.col("n")).otherwise(0.0))


def gate_from_python(name: str, judge: Callable[..., pd.DataFrame], *columns: str) -> Gate:
    """A gate from a function of pandas columns to passed, score and reason, in Arrow batches."""
    # no annotations: the function's own module need not hold them
    found = F.pandas_udf(lambda *c: judge(*c), "passed boolean, score double, reason string")(*columns)
    return Gate(name, found["passed"], found["score"], found["reason"])


def filter_names(history: Column, passed: bool) -> Column:
    """Names of the gates that passed, or that failed."""
    return F.transform(F.filter(history, lambda r: r["passed"] == F.lit(passed)), lambda r: r["filter_name"])


def is_correct(predicted: Column, answer: Column) -> Column:
    """Null without a prediction."""
    return predicted == answer


def measured(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with columns for what the gates measure of a text, and these by name; the text is split and searched once.

    Each measure is a column of its own and not a field of one, so what no plan reads is not measured.
    """
    body, hold = X.or_empty(F.col(text)), lambda n: f"_measured_{n}"
    tokens = hold("tokens")
    parts = pinned(df, **{tokens: X.tokens(body)})
    found = {
        "chars": F.length(body), "fenced": body.contains("```"), "garbage": X.garbage_count(body), "words": F.size(tokens),
        "longest": F.coalesce(F.array_max(F.transform(tokens, F.length)), F.lit(0)),
        "latin": F.size(F.filter(tokens, lambda x: x.rlike("[A-Za-z]{2,}"))),
        "hangul_letters": X.hangul_count(body), "latin_letters": X.latin_count(body),
    }
    return pinned(parts, **{hold(n): c for n, c in found.items()}), {n: F.col(hold(n)) for n in found}


def rule_verdicts(measures: dict[str, Column], predicted: Column, gold: Column, limits: RuleGates = RuleGates()) -> Column:
    """The four rule gates, from ``measured``; ``predicted`` and ``gold`` are letters."""
    answered, some = X.letter(predicted), measures["chars"] > 0
    clean = measures["garbage"] / F.greatest(measures["chars"], F.lit(1)) <= limits.garbage_ratio_max
    readable = some & ~measures["fenced"] & clean & (measures["longest"] <= limits.max_run_no_space)
    each = {
        "correctness": F.coalesce(answered == gold, F.lit(False)),
        "readability": readable,
        "format_parse": answered.isNotNull() & some,
        "length": measures["words"].between(limits.min_words, limits.max_words),
    }
    return F.struct(*(each[g].alias(g) for g in GATES))


def passes_all(verdicts: Column) -> Column:
    out = F.lit(True)
    for g in GATES:
        out = out & verdicts[g]
    return out
