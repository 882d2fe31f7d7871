"""Counterfactual signals from stored judge scores, and the decision over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.config import GapGate
from tracemill.functions import text as X
from tracemill.operators.gates import Gate


def best_counterfactual(scores: Column) -> Column:
    """The largest score that is not null."""
    return F.array_max(scores)


def gap(orig: Column, scores: Column) -> Column:
    return orig - best_counterfactual(scores)


def hedge_signals(orig_cot: Column, cf_cots: Column) -> Column:
    """Hedge rates of the original's and the counterfactuals' think blocks, and how far they differ.

    Rates of counterfactuals are rounded to four places before they are compared; a counterfactual
    without a think block has none.
    """
    rate = lambda c: X.bound(X.think_block(c), lambda b: F.when(b != "", F.bround(X.hedge_rate(b), 4)))
    rates = F.struct(X.hedge_rate(X.think_block(orig_cot)).alias("orig"), F.transform(cf_cots, rate).alias("each"))
    return X.bound(rates, lambda r: _signals(r["orig"], r["each"]))


def _signals(orig: Column, each: Column) -> Column:
    valid = F.filter(each, lambda r: r.isNotNull())
    mean = F.when(F.size(valid) > 0, F.aggregate(valid, F.lit(0.0), lambda a, r: a + r) / F.size(valid))
    return F.struct(
        F.bround(orig, 4).alias("orig_hedge_rate"), F.array_min(each).alias("cf_hedge_min"),
        F.array_max(each).alias("cf_hedge_max"), F.bround(mean, 4).alias("cf_hedge_mean"),
        F.bround(orig - F.array_min(each), 4).alias("hedge_gap"), each.alias("per_cf"),
    )


def label(orig: Column, gap_: Column, hedge_gap: Column, limits: GapGate = GapGate()) -> Column:
    """keep, rescued, rej_gap or rej_minorig; null without a gap."""
    low = F.lit(False) if limits.min_orig is None else orig < limits.min_orig
    small = gap_ < limits.gap
    cut = F.lit(True) if limits.hedge is None else F.coalesce(hedge_gap >= limits.hedge, F.lit(False))
    return (
        F.when(gap_.isNull(), F.lit(None).cast("string"))
        .when(low, "rej_minorig").when(small & cut, "rej_gap").when(small, "rescued").otherwise("keep")
    )


def counterfactual_gate(orig: Column, scores: Column, hedge_gap: Column, limits: GapGate = GapGate()) -> Gate:
    """The gate with its score, the gap, and a reason for each rejection."""
    g = gap(orig, scores)
    kind = label(orig, g, hedge_gap, limits)
    passed = F.when(kind.isNull(), F.lit(limits.on_missing == "pass")).otherwise(kind.isin("keep", "rescued"))
    reason = (
        F.when(kind.isNull() & ~passed, "scores are missing")
        .when(kind == "rej_minorig", F.format_string("original score %.2f below %.2f", orig, F.lit(limits.min_orig or 0.0)))
        .when(kind == "rej_gap", F.format_string("gap %.2f below %.2f", g, F.lit(float(limits.gap))))
    )
    return Gate("counterfactual", passed, g, reason)


def assemble(cf: DataFrame, originals: DataFrame, reference: DataFrame) -> DataFrame:
    """Counterfactual rows with what originals and the reference know of the same question.

    All have ``subset`` and ``sample_idx``; the row's own fields win, then the reference's.
    """
    key = ["subset", "sample_idx"]
    o = originals.select(*key, F.col("cot").alias("o_cot"), F.col("predicted").alias("o_predicted"))
    r = reference.select(*key, F.col("question").alias("r_question"), F.col("choices").alias("r_choices"), F.col("gold").alias("r_gold"))
    out = cf.join(o, key, "left").join(r, key, "left")
    gold = F.coalesce(X.index_of_letter(F.col("gold_letter")), F.when(F.col("r_gold") > 4, F.col("r_gold") - 1).otherwise(F.col("r_gold")))
    return out.select(
        *key, gold.alias("answer"), F.coalesce("r_question", "question").alias("question"), F.col("r_choices").alias("choices"),
        F.coalesce(F.col("o_cot"), F.lit("")).alias("cot"), "o_predicted",
        X.joined_cot(F.col("cf_reasoning_content"), F.col("cf_content")).alias("cf_cot"), "wrong_letter",
    )


def wrong_choices(key: Column, gold: Column, n_choices: Column, k: int = 1, seed: int = 42) -> Column:
    """``k`` options that are not gold, in an order by hash of seed, key and option."""
    others = F.filter(F.sequence(F.lit(0), n_choices - 1), lambda i: i != gold)
    ranked = F.array_sort(
        F.transform(
            others,
            lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")),
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda x: x["i"])


def open_ended(orig: Column, cf: Column, limits: GapGate = GapGate(hedge=None)) -> Column:
    """Gap, whether the row is dropped, and why; a low original is the first reason.

    Without one of the scores the gap is null, a low original is still dropped, and else the row stays, as ``missing``.
    """
    low = F.coalesce(orig < (limits.min_orig if limits.min_orig is not None else float("-inf")), F.lit(False))
    small = F.coalesce((orig - cf) < limits.gap, F.lit(False))
    reason = F.when(low, "orig<min").when(small, "gap<thr").when((orig - cf).isNull(), "missing").otherwise("")
    return F.struct((orig - cf).alias("gap"), (low | small).alias("drop"), reason.alias("reason"))
