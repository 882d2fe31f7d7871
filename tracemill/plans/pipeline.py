"""All stages from traces to exported arms as one plan, with tables between stages that are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import GapGate, RuleGates
from tracemill.operators import arms, counterfactual
from tracemill.workspace import exists, write_text


def staged(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read where it was written before, else made, written and read."""
    path = f"{root.rstrip('/')}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(
    spark: SparkSession, root: str, traces: DataFrame, bank: DataFrame, counterfactuals: DataFrame, quality: DataFrame,
    rules: RuleGates = RuleGates(), limits: GapGate = GapGate(), seed: int = 42, instruction: str = "Solve the question.",
) -> dict[str, DataFrame]:
    """The hub with all arms, the size matrix, and one export per arm.

    ``counterfactuals``: id, orig_score, cf_scores, orig_cot, cf_cots.  ``quality``: id, c2_score.
    Stages that have been written are read again, so a broken run goes on where it stopped.
    """
    hub = staged(spark, root, "unified", lambda: arms.unified(traces, bank, rules))
    hedge = counterfactual.hedge_signals(F.col("orig_cot"), F.col("cf_cots"))["hedge_gap"]
    gate = counterfactual.counterfactual_gate(F.col("orig_score"), F.col("cf_scores"), F.col("hedge_gap"), limits)
    decided = counterfactuals.withColumn("hedge_gap", hedge).select("id", gate.passed.alias("passed"), gate.score.alias("gap"), "orig_score")
    decided = staged(spark, root, "decided", lambda: decided)

    def with_arms() -> DataFrame:
        rows = arms.merge_c3(hub, decided).join(quality.select("id", F.col("c2_score").alias("_q")), "id", "left")
        rows = rows.withColumn("signals", F.col("signals").withField("c2_score", F.col("_q"))).drop("_q")
        # rankings read the written table, not the joins again
        scored = staged(spark, root, "scored", lambda: rows)
        return arms.merge_ranked(scored, seed)

    final = staged(spark, root, "arms", with_arms)
    exports = {a: arms.export_chat(final, a, instruction) for a in arms.ARMS}
    return {"hub": final, "sizes": arms.arm_matrix(final), **exports}


def report(sizes: DataFrame, accuracy: DataFrame, pairs: DataFrame, path: str | None = None) -> str:
    """A Markdown report of small aggregates; written to ``path`` if given."""

    def table(df: DataFrame, title: str, most: int = 10_000) -> str:
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title}: a report is for aggregates of at most {most} rows")
        cell = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
        lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""])

    text = "\n".join([
        "# Report", "", table(sizes.orderBy("subject"), "Arms"), table(accuracy.orderBy("arm"), "Accuracy"),
        table(pairs.orderBy("a", "b"), "Pairs"),
    ])
    if path:
        write_text(sizes.sparkSession, path, text)
    return text
