"""Prompts as columns: styles of asking, with a block of worked examples per subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X

STYLES = {
    "steps": "Work through the question in the four steps [Step 1] to [Step 4], then give the answer on a line of its own.",
    "free": "Think about the question as long as you need, then give the answer on a line of its own.",
    "target": "Argue as convincingly as you can that the option named below is right, then give it on a line of its own.",
}
ANSWER_FORM = f"Form of the last line: {X.ANSWER_WORD}: X, where X is a letter from A to E."


def few_shot_blocks(examples: DataFrame, k: int = 3) -> DataFrame:
    """``subset`` and ``shots``: up to ``k`` examples (question, choices, answer) by position, as one text."""
    one = F.concat(X.question_block(F.col("question"), F.col("choices")), F.lit(f"\n{X.ANSWER_WORD}: "), F.col("answer"))
    rows = examples.where(F.col("position") < k).select("subset", F.struct("position", one.alias("text")).alias("e"))
    texts = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"])
    return rows.groupBy("subset").agg(F.array_join(texts, "\n\n").alias("shots"))


def prompt(question: Column, choices: Column, style: str, shots: Column | None = None, target: Column | None = None) -> Column:
    """The style's instruction, the examples if there are any, the question, and the option to argue for."""
    parts = [F.lit(STYLES[style]), F.lit(ANSWER_FORM)]
    if shots is not None:
        parts.append(F.when(X.or_empty(shots) != "", shots))
    parts.append(X.question_block(question, choices))
    if target is not None:
        parts.append(F.concat(F.lit("Option: "), target))
    return F.concat_ws("\n\n", *parts)


def judge_prompt(question: Column, choices: Column, reasoning: Column, limit: int = 8000) -> Column:
    """What a judge reads: the question, and the reasoning within a limit."""
    ask = 'Grade from 1 to 5 how convincing the reasoning is, as JSON: {"supported_letter": "X", "score": n, "reason": "..."}'
    return F.concat_ws("\n\n", F.lit(ask), X.question_block(question, choices), F.concat(F.lit("[Reasoning]\n"), X.internal_reasoning(reasoning, limit)))
