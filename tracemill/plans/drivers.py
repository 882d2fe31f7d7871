"""What commands run: calibration, checks of cuts, judges compared, quality scores, samples of equal length or size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import arms, calibration, counterfactual, judging, stats
from tracemill.operators.judging import Call
from tracemill.workspace import Workspace, exists


def signals(scored: DataFrame, hub: DataFrame | None = None) -> DataFrame:
    """``id``, ``orig``, ``gap`` and ``hedge_gap`` of judged samples; of C1's only, where a hub is given."""
    cf = scored.select("id", "cot", F.col("metadata.counterfactual").alias("c")).where("c IS NOT NULL")
    hedge = counterfactual.hedge_signals(F.col("cot"), F.transform("c.counterfactuals", lambda x: x["cf_cot"]))["hedge_gap"]
    scores = F.transform("c.counterfactuals", lambda x: x["cf_score"])
    rows = cf.select("id", F.col("c.orig_score").alias("orig"), counterfactual.gap(F.col("c.orig_score"), scores).alias("gap"), hedge.alias("hedge_gap"))
    return rows if hub is None else calibration.restrict(rows, hub.where("filters.C1"))


def calibrate(rows: DataFrame, gaps: list[float], hedges: list[float | None], min_origs: list[float | None]) -> dict:
    """The gap's distribution, the sweep over thresholds, and the unsupervised cut with what it rests on: small tables only."""
    rows = Workspace(rows.sparkSession, "calibrate").save(rows, "signals")
    spread = calibration.distribution(rows, "gap").first().asDict(recursive=True)
    grid = [r.asDict() for r in calibration.sweep(rows, gaps, hedges, min_origs).collect()]  # a row for each combination
    two = calibration.mixture(rows, "gap").first()
    cut = calibration.otsu(rows, "gap").first()
    found = None
    if two is not None:
        m = calibration.Mixture((two.mu0, two.mu1), (two.var0, two.var1), (two.weight0, two.weight1), two.crossover, two.bic1, two.bic2, two.separation)
        found = calibration.auto_cut(m, cut["cut"] if cut else None)
        found["text"] = calibration.auto_cut_text(found)
    return {"distribution": spread, "sweep": grid, "mixture": two.asDict() if two else None, "otsu": cut.asDict() if cut else None, "auto": found}


def compare_judges(
    samples: DataFrame, ref: Call, cand: Call, reps: int = 1, label_min: float = 0.80, reject_min: float = 0.85, cut: float = 1.5
) -> tuple[DataFrame, dict]:
    """Both judges' scores by text, and whether the candidate may stand in: agreement, kappa, ranks, rejected sets, sanity.

    A text is supported from 3 points on.  A sample is rejected if its original scores less than ``cut`` above its
    best counterfactual.  The candidate is sane if it scores at least as many texts as it fails to.
    """
    rows, stopped = judging.compared(samples, ref, cand, reps=reps)
    rows = Workspace(samples.sparkSession, "compare").save(rows, "rows")
    both = rows.withColumn("ref_label", F.col("ref_score") >= 3).withColumn("cand_label", F.col("cand_score") >= 3)
    label = both.agg(*stats.agreement(F.col("ref_label"), F.col("cand_label"))).first()
    kappa = stats.cohen_kappa(both, "ref_label", "cand_label").first()
    rho = stats.spearman(both, "ref_score", "cand_score").first()
    side = lambda n: F.max(F.when(F.col("k") < 0, F.col(n))) - F.max(F.when(F.col("k") >= 0, F.col(n))) < cut
    each = rows.groupBy("id").agg(F.coalesce(side("ref_score"), F.lit(False)).alias("a"), F.coalesce(side("cand_score"), F.lit(False)).alias("b"))
    sets = each.agg(*stats.set_agreement(F.col("a"), F.col("b"))).first()
    seen = rows.agg(F.count(F.lit(1)).alias("texts"), F.count("ref_score").alias("ref"), F.count("cand_score").alias("cand")).first()
    sane = seen.cand * 2 >= seen.texts
    rate = sets["same"] / sets["n"] if sets["n"] else None
    one = samples.sparkSession.range(1).select(stats.swap_verdict(F.lit(label["rate"]).cast("double"), F.lit(rate).cast("double"), F.lit(sane), label_min, reject_min).alias("v"))
    verdict = one.first().v.asDict()
    summary = {
        "texts": seen.texts, "scored_by_ref": seen.ref, "scored_by_cand": seen.cand, "sane": sane, "stopped": stopped,
        "label_agreement": label["rate"], "kappa": kappa["kappa"], "spearman": rho["rho"], "reject_agreement": rate, "reject_jaccard": sets["jaccard"],
        **verdict,
    }
    return rows, summary


def score_quality(spark: SparkSession, root: str, hub: DataFrame, call: Call, reps: int = 1, tries: int = 3) -> DataFrame:
    """The hub with quality scores for C1; good ones are kept under ``root``, and a run that goes on asks for the rest."""
    path = f"{root.rstrip('/')}/quality"
    if exists(spark, path):
        # what is being read must not be appended to
        hub = judging.with_quality(hub, Workspace(spark, "quality").save(spark.read.schema("id string, c2_score double").parquet(path), "kept"))
    new = Workspace(spark, "quality").save(judging.quality(hub, call, reps, tries), "new")
    new.where("c2_score IS NOT NULL").write.mode("append").parquet(path)
    return judging.with_quality(hub, new)


def selected(hub: DataFrame, ids: DataFrame, arm: str, instruction: str) -> tuple[DataFrame, DataFrame]:
    """The chat export of chosen ids, whatever arm they are in, and a summary of what was chosen."""
    chosen = hub.join(ids.select("id"), "id", "left_semi")
    flagged = chosen.withColumn("filters", F.col("filters").withField(arm, F.lit(True)))
    facts = chosen.select("subject", "tokens", F.col("signals.gap").alias("gap"), F.col("signals.c2_score").alias("c2_score"))
    return arms.export_chat(flagged, arm, instruction), arms.selection_summary(facts)


def as_text(found: dict) -> str:
    return json.dumps(found, ensure_ascii=False, indent=2, default=str)
