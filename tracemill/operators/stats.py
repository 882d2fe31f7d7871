"""Paired statistics over evaluation results of arms and seeds.

Results are one long table: arm, seed, subset, sample_idx, is_correct (0 or 1) and what else is known.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import degenerate
from tracemill.operators.once import running
from tracemill.session import ship_package

ITEM = ["subset", "sample_idx"]


def last_results(rows: DataFrame, position: str = "pos") -> DataFrame:
    """One result per arm, seed and item: the last one by position wins."""
    ok = F.coalesce(F.col("is_correct").cast("int"), F.lit(0))
    return rows.groupBy("arm", "seed", *ITEM).agg(F.max_by(ok, position).alias("ok"))


def without_degenerate(rows: DataFrame) -> DataFrame:
    """Results whose output is neither unparsed nor too long."""
    return rows.where(~degenerate(F.col("predicted"), F.col("output_chars")))


def per_item(results: DataFrame, common: bool = True) -> DataFrame:
    """Mean over seeds of each arm's items; ``common`` keeps items that all of the arm's seeds have."""
    items = results.groupBy("arm", *ITEM).agg(F.sum("ok").alias("right"), F.count(F.lit(1)).alias("seeds"))
    items = items.withColumn("mean", F.col("right") / F.col("seeds"))
    if not common:
        return items
    seeds = results.groupBy("arm").agg(F.count_distinct("seed").alias("all_seeds"))
    return items.join(F.broadcast(seeds), "arm").where("seeds = all_seeds").drop("all_seeds")


def seed_accuracy(results: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds of each arm's accuracy; 0 with a single seed."""
    each = results.groupBy("arm", "seed").agg((F.sum("ok") / F.count(F.lit(1))).alias("acc"))
    return each.groupBy("arm").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("acc").alias("mean"), F.coalesce(F.stddev_samp("acc"), F.lit(0.0)).alias("std")
    )


def subject_accuracy(items: DataFrame) -> DataFrame:
    return items.groupBy("arm", "subset").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("acc"))


def bootstrap_interval(items: DataFrame, draws: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of each arm's mean.

    An item's mean has few values, so resampling items is drawing multinomial counts of these values:
    equal in distribution, and as large as the number of seeds, not of items.
    """
    hist = items.groupBy("arm", F.col("mean").alias("v")).agg(F.count(F.lit(1)).alias("c"))

    def draw(key, rows):
        rows = rows.sort_values("v")
        c, v = rows["c"].to_numpy(np.int64), rows["v"].to_numpy(float)
        rng = np.random.default_rng([seed, *key[0].encode()])
        means = np.sort(rng.multinomial(int(c.sum()), c / c.sum(), draws) @ v / c.sum())
        lo, hi = means[int(alpha / 2 * draws)], means[min(int((1 - alpha / 2) * draws), draws - 1)]
        return pd.DataFrame({"arm": [key[0]], "n": [int(c.sum())], "mean": [float((c * v).sum() / c.sum())], "lo": [lo], "hi": [hi]})

    ship_package(items.sparkSession)
    return hist.groupBy("arm").applyInPandas(draw, "arm string, n long, mean double, lo double, hi double")


def mcnemar_table(items: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cells of the 2 x 2 table of each pair over common items, right meaning a mean of a half or more.

    Pairs of which an arm has no rows are left out.
    """
    if not pairs:
        raise ValueError("no pairs")
    wanted = items.sparkSession.createDataFrame(pairs, "a string, b string")
    side = items.select("arm", *ITEM, (F.col("mean") >= 0.5).alias("ok"))
    a = side.join(F.broadcast(wanted), side["arm"] == wanted["a"]).select("a", "b", *ITEM, F.col("ok").alias("x"))
    rows = a.join(side.select(F.col("arm").alias("b"), *ITEM, F.col("ok").alias("y")), ["b", *ITEM])
    x, y = F.col("x"), F.col("y")
    return rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"),
    )


def mcnemar(table: DataFrame, exact_below: int = 25) -> DataFrame:
    """Method, statistic and p: exact two-sided binomial for few discordant items, else corrected chi-square."""
    b, c = F.col("only_a"), F.col("only_b")
    n = b + c
    k = F.least(b, c)
    # sum of binomial terms by recurrence, from (n over 0) on
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), begin,
        lambda acc, i: F.struct(
            (acc["term"] * (n - i + 1) / i).alias("term"), (acc["sum"] + acc["term"] * (n - i + 1) / i).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    exact = F.least(F.lit(1.0), tail * 2 / F.pow(F.lit(2.0), n))
    gap = F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double")
    chi = gap * gap / n
    method = F.when(n == 0, "no_discordant").when(n < exact_below, "exact").otherwise("chi2")
    rows = table.withColumn("method", method).withColumn("statistic", F.when(F.col("method") == "chi2", chi))
    p = F.when(n == 0, 1.0).when(F.col("method") == "exact", exact).otherwise(complementary_error(F.sqrt(F.col("statistic") / 2)))
    return rows.withColumn("p", p)


def complementary_error(z: Column, near: float = 2.5) -> Column:
    """erfc of numbers from 0 on: the series of the error function near 0, a continued fraction beyond."""
    begin = F.struct(z.alias("term"), z.alias("sum"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), begin,
        lambda acc, k: F.struct(
            (-acc["term"] * z * z / k).alias("term"), (acc["sum"] - acc["term"] * z * z / k / (k * 2 + 1)).alias("sum")
        ),
        lambda acc: 1 - acc["sum"] * (2 / math.sqrt(math.pi)),
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: k / 2 / (z + t))
    return F.when(z < near, series).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / (z + fraction))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, right and unparsed ones, and the share right (null without rows)."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("right"),
        F.count_if(F.col("predicted").isNull()).alias("unparsed"),
    )
    return out.withColumn("acc", F.expr("try_divide(right, n)"))


def agreement(a: Column, b: Column) -> list[Column]:
    """Pairs without null, how many agree, and their share."""
    both = a.isNotNull() & b.isNotNull()
    n, same = F.count_if(both), F.count_if(both & (a == b))
    return [n.alias("n"), same.alias("same"), F.try_divide(same, n).alias("rate")]


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two labels: 1 where chance agreement is complete, null without pairs."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(
        F.count(F.lit(1)).alias("c")
    )
    mx = cells.groupBy("x").agg(F.sum("c").alias("cx")).withColumnRenamed("x", "l")
    my = cells.groupBy("y").agg(F.sum("c").alias("cy")).withColumnRenamed("y", "l")
    total = cells.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c"))), F.lit(0)).alias("same"))
    chance = mx.join(my, "l").agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("cross"))
    one = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return one.select("n", "same", "cross", F.when(F.col("n") > 0, F.when(pe >= 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))).alias("kappa"))


def set_agreement(a: Column, b: Column) -> list[Column]:
    """Of two flags: rows, agreeing ones, the intersection and union, and the Jaccard index (1 for an empty union)."""
    inter, union = F.count_if(a & b), F.count_if(a | b)
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("same"), inter.alias("both"), union.alias("either"),
        F.when(union == 0, 1.0).otherwise(F.try_divide(inter, union)).alias("jaccard"),
    ]


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties; null below three pairs.

    Ranks come from histograms of distinct values, so no window sees all rows.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    cells = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))

    def ranks(col: str, name: str) -> DataFrame:
        hist = running(cells.groupBy(col).agg(F.sum("c").alias("k")), col, {"upto": F.col("k")})
        return hist.select(col, (F.col("upto") - F.col("k") + (F.col("k") + 1) / F.lit(2.0)).alias(name))

    r = cells.join(ranks("x", "rx"), "x").join(ranks("y", "ry"), "y")
    s = r.agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rx")).alias("sx"), F.sum(F.col("c") * F.col("ry")).alias("sy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("yy"),
        F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("xy"),
    )
    cov = F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("yy") - F.col("sy") * F.col("sy")
    return s.select("n", F.when((F.col("n") >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)).alias("rho"))


def first_mode(rows: DataFrame, by: list[str], label: str, position: str) -> DataFrame:
    """The most frequent label of a group; of equals, the one seen first."""
    each = rows.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"), F.min(position).alias("p"))
    return each.groupBy(*by).agg(F.max_by(label, F.struct("c", -F.col("p"))).alias("mode"))


def judge_instances(rows: DataFrame) -> DataFrame:
    """Original and counterfactual judgements of two judges (``ds``, ``cand``) as one row per instance."""
    fields = ["supported_letter", "matches_target", "score"]
    pick = lambda side, item: [item[f].alias(f"{side}_{f}") for f in fields]
    orig = rows.select("id", F.lit("orig").alias("kind"), F.lit(-1).alias("k"), *pick("ds", F.col("ds.orig")), *pick("cand", F.col("cand.orig")))
    cfs = rows.select("id", F.posexplode(F.arrays_zip(F.col("ds.cfs").alias("d"), F.col("cand.cfs").alias("c"))).alias("k", "z"))
    return orig.unionByName(cfs.select("id", F.lit("cf").alias("kind"), "k", *pick("ds", F.col("z.d")), *pick("cand", F.col("z.c"))))


def swap_verdict(label_rate: Column, reject_rate: Column, sane: Column, label_min: float = 0.80, reject_min: float = 0.85) -> Column:
    """Whether a judge may replace another, and whether a rate is within 0.05 of its limit."""
    ok = F.coalesce((label_rate >= label_min) & (reject_rate >= reject_min) & sane, F.lit(False))
    near = F.coalesce((F.abs(label_rate - label_min) <= 0.05) | (F.abs(reject_rate - reject_min) <= 0.05), F.lit(False))
    return F.struct(ok.alias("swap"), near.alias("borderline"))


def early_answer(rows: DataFrame) -> DataFrame:
    """Accuracy at the first and last fraction of reasoning, its gain, commit ratio and area over the curve."""
    acc = rows.groupBy("frac").agg(F.avg(F.coalesce("correct", F.lit(False)).cast("int")).alias("acc"))
    order = W.orderBy("frac")  # one row per fraction
    acc = acc.withColumn("f0", F.lag("frac").over(order)).withColumn("a0", F.lag("acc").over(order))
    acc = acc.withColumn("final", F.max_by("acc", "frac").over(W.partitionBy(F.lit(0))))
    part = (F.col("frac") - F.col("f0")) * ((F.col("final") - F.col("a0")) + (F.col("final") - F.col("acc"))) / 2
    out = acc.agg(F.min_by("acc", "frac").alias("floor"), F.max("final").alias("final"), F.coalesce(F.sum(part), F.lit(0.0)).alias("aoc"))
    return out.withColumn("gain", F.col("final") - F.col("floor")).withColumn("commit", F.expr("try_divide(floor, final)"))


def generation_summary(rows: DataFrame, input_price: float = 0.0, output_price: float = 0.0) -> DataFrame:
    """By subset with a total (``ALL``): rows, errors, right ones, well-formed ones, tokens and cost per million."""
    good = F.col("error").isNull()
    out = rows.rollup("subset").agg(
        F.grouping("subset").alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("errors"),
        F.count_if(good & F.coalesce("is_correct", F.lit(False))).alias("right"),
        F.count_if(good & F.coalesce("well_formed", F.lit(False))).alias("well_formed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    cost = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6
    name = F.when(F.col("_g") == 1, "ALL").otherwise(F.col("subset"))
    return out.withColumn("subset", name).withColumn("cost", cost).drop("_g")


def evaluation_summary(rows: DataFrame, by: str = "subset", *runs: str) -> DataFrame:
    """``accuracy`` by subset, with a total (``ALL``); of each run, where columns that tell runs apart are given."""
    sets = [[F.col(c) for c in (*runs, by)], [F.col(c) for c in runs]]
    out = rows.groupingSets(sets, *(F.col(c) for c in (*runs, by))).agg(
        F.grouping(by).alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("right"),
        F.count_if(F.col("predicted").isNull()).alias("unparsed"),
    )
    name = F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by))
    return out.withColumn(by, name).withColumn("acc", F.expr("try_divide(right, n)")).drop("_g")


def histogram(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Rows by value; null is a value."""
    return rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def reasoning_gain(without: Column, with_: Column) -> list[Column]:
    """Accuracy without and with reasoning, the gain, and the share that needs none (null if nothing is right)."""
    a, b = F.avg(F.coalesce(without, F.lit(False)).cast("int")), F.avg(F.coalesce(with_, F.lit(False)).cast("int"))
    return [a.alias("without"), b.alias("with"), (b - a).alias("gain"), F.try_divide(a, b).alias("commit")]


def rescore_delta(old: Column, new: Column, gold: Column) -> list[Column]:
    """Right answers before and after, unparsed ones before and after, and how many changed."""
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(old == gold, F.lit(False))).alias("old_right"),
        F.count_if(F.coalesce(new == gold, F.lit(False))).alias("new_right"), F.count_if(old.isNull()).alias("old_null"),
        F.count_if(new.isNull()).alias("new_null"), F.count_if(~old.eqNullSafe(new)).alias("changed"),
    ]


def open_ended_summary(rows: DataFrame) -> DataFrame:
    """Of ``gap`` and ``reason``: mean, median, extremes, and drops by reason."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.min("gap").alias("least"),
        F.max("gap").alias("most"), F.count_if("drop").alias("dropped"), F.count_if(F.col("reason") == "orig<min").alias("low"),
        F.count_if(F.col("reason") == "gap<thr").alias("small"),
    )


def known_pairs(items: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs of arms that both have results; the others are undefined and left out."""
    arms = {r["arm"] for r in items.select("arm").distinct().collect()}  # one name for each arm
    return [p for p in pairs if set(p) <= arms]


def statistics(results: DataFrame, pairs: list[tuple[str, str]], draws: int = 10_000, common: bool = True) -> dict[str, DataFrame]:
    """All tables of an evaluation: accuracies, intervals, subjects, and McNemar for pairs of arms.

    McNemar compares items that all of an arm's seeds have; with ``common`` false the intervals are over
    items that any of them has, which is what results without degenerate ones need.
    """
    items = per_item(results)
    return {
        "accuracy": seed_accuracy(results), "interval": bootstrap_interval(items if common else per_item(results, False), draws),
        "subjects": subject_accuracy(items), "pairs": mcnemar(mcnemar_table(items, pairs)),
    }


def twin(rows: DataFrame, pairs: list[tuple[str, str]], draws: int = 10_000) -> dict[str, dict[str, DataFrame]]:
    """The statistics over all results and over those that are not degenerate, which go before the last one is taken."""
    return {
        "all": statistics(last_results(rows), pairs, draws),
        "clean": statistics(last_results(without_degenerate(rows)), pairs, draws, common=False),
    }


def as_json(tables: dict[str, DataFrame]) -> str:
    """Small tables as one JSON text, rows sorted."""
    rows = {name: sorted((r.asDict(recursive=True) for r in df.collect()), key=repr) for name, df in tables.items()}
    return json.dumps(rows, ensure_ascii=False, indent=2)


def hypothesis_rows(accuracy_: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Whether the first arm of each pair has the higher mean."""
    wanted = accuracy_.sparkSession.createDataFrame(pairs, "a string, b string")
    a = accuracy_.select(F.col("arm").alias("a"), F.col("mean").alias("mean_a"))
    b = accuracy_.select(F.col("arm").alias("b"), F.col("mean").alias("mean_b"))
    return wanted.join(a, "a").join(b, "b").withColumn("holds", F.col("mean_a") > F.col("mean_b"))


def design_grid(arms: list[str], seeds: list[int], sizes: list[int]):
    """All runs of a design, in order."""
    return [(a, s, n) for n in sizes for a in arms for s in seeds]
