"""Threshold calibration over stored signals: everything works on histograms of distinct values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.once import running
from tracemill.session import ship_package


def restrict(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids``."""
    return rows.join(ids.select("id"), "id", "left_semi")


def sweep(signals: DataFrame, gaps: list[float], hedges: list[float | None], min_origs: list[float | None]) -> DataFrame:
    """Decision counts for each combination of thresholds, from one pass over ``orig``, ``gap``, ``hedge_gap``.

    The grid is broadcast against the histogram of signals, and counts are combined before the shuffle.
    """
    grid = [(m, h, g) for m in min_origs for h in hedges for g in gaps]
    hist = signals.groupBy("orig", "gap", "hedge_gap").agg(F.count(F.lit(1)).alias("c"))
    points = signals.sparkSession.createDataFrame(
        [(i, *(None if x is None else float(x) for x in p)) for i, p in enumerate(grid)], "i int, m double, h double, g double"
    )
    low = F.col("m").isNotNull() & F.coalesce(F.col("orig") < F.col("m"), F.lit(False))
    small = F.col("gap") < F.col("g")
    cut = F.col("h").isNull() | F.coalesce(F.col("hedge_gap") >= F.col("h"), F.lit(False))
    kind = (
        F.when(F.col("gap").isNull(), F.lit(None).cast("string"))
        .when(low, "rej_minorig").when(small & cut, "rej_gap").when(small, "rescued").otherwise("keep")
    )
    rows = points.join(hist.crossJoin(F.broadcast(points.select("i", "m", "h", "g"))).select("i", kind.alias("kind"), "c"), "i", "left")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("c"))), F.lit(0)).alias(k)
    out = rows.groupBy("i", F.col("m").alias("min_orig"), F.col("h").alias("hedge"), F.col("g").alias("gap")).agg(
        *(total(k) for k in ("keep", "rescued", "rej_gap", "rej_minorig"))
    )
    kept, gone = F.col("keep") + F.col("rescued"), F.col("rej_gap") + F.col("rej_minorig")
    out = out.drop("i").withColumn("kept", kept).withColumn("rejected", gone)
    return out.withColumn("rejected_share", F.expr("try_divide(rejected, kept + rejected)"))


def nearest_ranks(values: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """``q`` and ``value`` at rank int(q * (n - 1) + 0.5), from the histogram."""
    hist = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    hist = running(hist, "v", {"upto": F.col("c")})
    at = lambda q: F.least(F.col("upto_all") - 1, F.floor(q * (F.col("upto_all") - 1) + F.lit(0.5)).cast("long"))
    own = F.filter(
        F.array(*(F.lit(float(q)) for q in shares)), lambda q: (F.col("upto") > at(q)) & (F.col("upto") - F.col("c") <= at(q))
    )
    return hist.select(F.explode(own).alias("q"), F.col("v").alias("value"))


def distribution(values: DataFrame, value: str, shares: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1)) -> DataFrame:
    """Count, mean and nearest-rank quantiles in one row."""
    q = nearest_ranks(values, value, list(shares))
    row = q.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("q", "value")))).alias("quantiles"))
    return values.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).crossJoin(F.broadcast(row))


def otsu(values: DataFrame, value: str) -> DataFrame:
    """The cut between two distinct values with the largest variance between classes, and its share of all."""
    hist = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    c, v = F.col("c"), F.col("v")
    rows = running(hist, "v", {"n0": c, "s0": c * v, "q0": c * v * v})
    # the next value: rows with the same sum before them as this one has with itself
    after = rows.select((F.col("n0") - c).alias("n0"), F.col("v").alias("next"))
    rows = rows.join(after, "n0").withColumnsRenamed({"n0_all": "n", "s0_all": "s", "q0_all": "ss"})
    w0, w1 = F.col("n0") / F.col("n"), (F.col("n") - F.col("n0")) / F.col("n")
    step = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    rows = rows.withColumn("between", w0 * w1 * step * step)
    whole = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    rows = rows.withColumn("share", F.when(whole > 0, F.col("between") / whole))
    best = rows.withColumn("cut", (F.col("v") + F.col("next")) / 2).orderBy(F.desc("between"), "cut").limit(1)
    return best.select("cut", "between", "share", "n")


@dataclass(frozen=True)
class Mixture:
    mu: tuple[float, float]
    var: tuple[float, float]
    weight: tuple[float, float]
    crossover: float | None
    bic1: float
    bic2: float
    separation: float


def _density(x: np.ndarray, mu: float, var: float) -> np.ndarray:
    return np.exp(-((x - mu) ** 2) / (2 * var)) / math.sqrt(2 * math.pi * var)


def two_components(
    values: np.ndarray, counts: np.ndarray, within: np.ndarray | float = 0.0, rounds: int = 300, floor: float = 0.05, steps: int = 400
) -> Mixture:
    """Two normal components by EM over values with counts, in ascending order.

    A value may be the mean of a bin; ``within`` is then the variance in each, which variances take in.
    """
    n = counts.sum()
    mean = float((values * counts).sum() / n)
    var = max(float((counts * ((values - mean) ** 2 + within)).sum() / n), 1e-6)
    upto = np.cumsum(counts)
    mu = np.array([values[np.searchsorted(upto, k, "right")] for k in (n // 4, 3 * n // 4)], float)
    if mu[0] == mu[1]:
        mu = mean + np.array([-1.0, 1.0]) * math.sqrt(var)
    v, w = np.array([var, var]), np.array([0.5, 0.5])
    dense = lambda x: np.stack([w[k] * _density(x, mu[k], v[k]) for k in (0, 1)])
    for _ in range(rounds):
        p = dense(values)
        total = p.sum(0)
        p = p / np.where(total > 0, total, 1e-12) * counts
        size = np.maximum(p.sum(1), 1e-12)
        mu = (p * values).sum(1) / size
        v = np.maximum((p * ((values - mu[:, None]) ** 2 + within)).sum(1) / size, floor)
        w = size / n
    order = np.argsort(mu, kind="stable")
    mu, v, w = mu[order], v[order], w[order]
    two = float((counts * np.log(np.maximum(dense(values).sum(0), 1e-300))).sum())
    one = float((counts * np.log(np.maximum(_density(values, mean, var), 1e-300))).sum())
    cross = None
    if mu[1] > mu[0]:
        t = mu[0] + (mu[1] - mu[0]) * np.arange(steps + 1) / steps
        first, second = dense(t)
        d = first - second
        turns = np.flatnonzero(((d[1:] <= 0) & (d[:-1] > 0)) | ((d[1:] >= 0) & (d[:-1] < 0)))
        cross = float(t[turns[0] + 1]) if len(turns) else None
    spread = math.sqrt(float(v.mean()))
    return Mixture(
        tuple(map(float, mu)), tuple(map(float, v)), tuple(map(float, w)), cross,
        -2 * one + 2 * math.log(n), -2 * two + 5 * math.log(n), abs(float(mu[1] - mu[0])) / spread if spread else 0.0,
    )


#: Bins of equal width between the least and the greatest value on which a mixture is fitted, at any size.
BINS = 1 << 16


def binned(values: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """``v``, ``c`` and ``within``: mean, count and variance of the values in each bin; ``bins`` + 1 rows at most."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = rows.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))  # one row
    own = F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0))
    rows = rows.crossJoin(F.broadcast(ends)).groupBy(own.alias("_bin"))
    return rows.agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("c"), F.var_pop("v").alias("within")).drop("_bin")


def mixture(values: DataFrame, value: str) -> DataFrame:
    """The mixture as one row; an executor fits it on bins, of which there are no more than ``BINS`` + 1.

    Where each distinct value has a bin of its own, as scores of few steps have, that is the fit of all values;
    else it is off by less than a bin's width.
    """
    schema = (
        "mu0 double, mu1 double, var0 double, var1 double, weight0 double, weight1 double, crossover double, "
        "bic1 double, bic2 double, separation double"
    )

    def fit(rows):
        rows = rows.sort_values("v")
        m = two_components(rows["v"].to_numpy(), rows["c"].to_numpy(float), rows["within"].to_numpy())
        return pd.DataFrame([[*m.mu, *m.var, *m.weight, m.crossover, m.bic1, m.bic2, m.separation]], columns=[
            "mu0", "mu1", "var0", "var1", "weight0", "weight1", "crossover", "bic1", "bic2", "separation",
        ]).astype(float)

    ship_package(values.sparkSession)
    return binned(values, value).groupBy(F.lit("all")).applyInPandas(fit, schema)


def auto_cut(m: Mixture, otsu_cut: float | None, fallback: float = 1.0, present: float = 1.5) -> dict:
    """The unsupervised cut, whether values are bimodal, how hard to verify it, and what to compare it with."""
    bimodal = m.bic2 < m.bic1 and m.separation >= 1.0 and min(m.weight) >= 0.10 and m.crossover is not None
    cut = m.crossover if bimodal else fallback
    effort = "light" if m.separation >= 2.0 else "normal" if m.separation >= 1.0 else "thorough"
    rivals = sorted({round(c, 2) for c in (cut, otsu_cut, fallback, present) if c is not None})
    return {"bimodal": bimodal, "cut": cut, "effort": effort, "candidates": rivals}


def auto_cuts(two: DataFrame, cut: DataFrame, fallback: float = 1.0, present: float = 1.5) -> DataFrame:
    """``auto_cut`` as a plan, from the one row of ``mixture`` and the one of ``otsu``; candidates are rounded as decimals."""
    row = two.crossJoin(F.broadcast(cut.select(F.col("cut").alias("_otsu"))))
    least = F.least("weight0", "weight1")
    bimodal = F.coalesce((F.col("bic2") < F.col("bic1")) & (F.col("separation") >= 1.0) & (least >= 0.10) & F.col("crossover").isNotNull(), F.lit(False))
    row = row.withColumn("bimodal", bimodal).withColumn("cut", F.when(F.col("bimodal"), F.col("crossover")).otherwise(F.lit(fallback)))
    effort = F.when(F.col("separation") >= 2.0, "light").when(F.col("separation") >= 1.0, "normal").otherwise("thorough")
    rivals = F.filter(F.transform(F.array("cut", "_otsu", F.lit(fallback), F.lit(present)), lambda c: F.bround(c, 2)), lambda c: c.isNotNull())
    return row.select("bimodal", "cut", effort.alias("effort"), F.array_sort(F.array_distinct(rivals)).alias("candidates"))


def auto_cut_text(found: dict) -> str:
    kind = "two groups" if found["bimodal"] else "one group, so the cut by meaning"
    rivals = ", ".join(f"{c:g}" for c in found["candidates"])
    return f"cut {found['cut']:g} ({kind}); verification: {found['effort']}; candidates: {rivals}"


def verify_cuts(accuracies: DataFrame, chosen: float | None) -> DataFrame:
    """One row on (``cut``, ``accuracy``, ``pos``): spread against seed noise, the best cut, and a verdict.

    Verdicts: flat (spread within noise), same, close (within the joint deviation), revisit, absent.
    The cut that came first (``pos``) wins ties.
    """
    each = accuracies.groupBy("cut").agg(
        F.avg("accuracy").alias("mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("std"),
        F.count("accuracy").alias("n"), F.min("pos").alias("pos"),
    ).where("n > 0")
    own = F.abs(F.col("cut") - F.lit(chosen)) < 1e-9 if chosen is not None else F.lit(False)
    out = each.agg(
        (F.max("mean") - F.min("mean")).alias("spread"),
        F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col("std"))), F.lit(0.0)).alias("noise"),
        F.max_by(F.struct("cut", "mean", "std"), F.struct("mean", -F.col("pos"))).alias("best"),
        F.first(F.when(own, F.struct("cut", "mean", "std")), ignorenulls=True).alias("own"),
    )
    lead = F.col("best.mean") - F.col("own.mean")
    joint = F.sqrt(F.col("best.std") * F.col("best.std") + F.col("own.std") * F.col("own.std"))
    verdict = (
        F.when(F.col("spread") <= F.greatest("noise", F.lit(1e-9)), "flat")
        .when(F.col("own").isNull(), "absent")
        .when(F.abs(F.col("best.cut") - F.col("own.cut")) < 1e-9, "same")
        .when(lead <= joint, "close").otherwise("revisit")
    )
    return out.select("spread", "noise", F.col("best.cut").alias("best_cut"), verdict.alias("verdict"))
