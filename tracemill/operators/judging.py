"""Judges that are asked several times: repetitions, tries, and what became of each.

A try is one call for each text that has no valid answer yet.  Its answers are written before they are
read, so no call is made twice because a plan is evaluated twice or an executor is lost; they are parsed
by column functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import judge as J
from tracemill.functions import prompts
from tracemill.functions import text as X
from tracemill.operators.once import numbered
from tracemill.operators.scoring import scored
from tracemill.schemas import LETTERS
from tracemill.workspace import Workspace

#: A row as a dict in, the judge's text out; raising is an error of that call.
Call = Callable[[dict], str]


def judged(
    rows: DataFrame, key: list[str], call: Call, parse: Callable[[Column], Column] = J.judge_score, reps: int = 1, tries: int = 3,
    kind: str = "int",
) -> DataFrame:
    """``key`` with ``runs``, ``mean``, ``raws`` and ``errors`` of ``reps`` repetitions, each of ``tries`` calls at most.

    ``runs`` has the scores, of type ``kind``, of repetitions that gave one and ``mean`` their mean, null without any;
    ``raws`` the last answer of each, null where there was none; ``errors`` null where a score was found,
    else ``empty_response``, ``parse_failed`` or the call's failure.  Rows whose ``skip`` column, if they
    have one, is not null are not asked: it becomes their one error.  ``key`` must identify a row.
    """
    space = Workspace(rows.sparkSession, "judged")
    has_skip = "skip" in rows.columns
    asked = rows.where("skip IS NULL").drop("skip") if has_skip else rows
    pending = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(reps, 1) - 1))).alias("rep"))
    done = None
    for i in range(tries):
        answers = space.save(scored(pending, lambda row: {"raw": call(row)}, "raw string", tries=1), f"try-{i}")
        score = parse(F.col("raw"))
        answers = answers.withColumn("score", score)
        failure = F.coalesce("error", F.when(X.strip(X.or_empty(F.col("raw"))) == "", "empty_response").otherwise("parse_failed"))
        answers = answers.withColumn("error", F.when(F.col("score").isNull(), failure))
        last = i == tries - 1
        settled = (answers if last else answers.where("score IS NOT NULL")).select(*key, "rep", "score", "raw", "error")
        done = settled if done is None else done.unionByName(settled)
        pending = answers.where("score IS NULL").select(*pending.columns)
    item = F.struct("rep", F.col("score").cast(kind).alias("score"), "raw", "error")
    each = done.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("r"))  # as many as repetitions
    valid = F.filter(F.transform("r", lambda x: x["score"]), lambda s: s.isNotNull())
    out = each.select(
        *key, valid.alias("runs"), J.mean_of_valid(valid).alias("mean"), F.transform("r", lambda x: x["raw"]).alias("raws"),
        F.transform("r", lambda x: x["error"]).alias("errors"),
    )
    if has_skip:
        none = F.array().cast(f"array<{kind}>"), F.lit(None).cast("double"), F.array().cast("array<string>")
        out = out.unionByName(rows.where("skip IS NOT NULL").select(
            *key, none[0].alias("runs"), none[1].alias("mean"), none[2].alias("raws"), F.array("skip").alias("errors")
        ))
    return out


def convincingness(rows: DataFrame, key: list[str], call: Call, reps: int = 1, tries: int = 3) -> DataFrame:
    """How well a text argues for an option: ``judged`` with ``target``, from ``question``, ``choices``, ``cot``, ``target_idx``.

    The call sees ``prompt`` and all other columns.  An option that is none has the error ``invalid target_idx``.
    """
    valid = F.coalesce(F.col("target_idx").between(0, len(LETTERS) - 1), F.lit(False))
    rows = rows.withColumn("prompt", prompts.judge_prompt(F.col("question"), F.col("choices"), F.col("cot")))
    wrong = F.concat(F.lit("invalid target_idx="), F.coalesce(F.col("target_idx").cast("string"), F.lit("None")))
    out = judged(rows.withColumn("skip", F.when(~valid, wrong)), key, call, reps=reps, tries=tries)
    target = F.when(valid, F.substr(F.lit(LETTERS), F.col("target_idx").cast("int") + 1, F.lit(1)))
    return out.join(rows.select(*key, target.alias("target")), key)


def quality(hub: DataFrame, call: Call, reps: int = 1, tries: int = 3) -> DataFrame:
    """``id`` and ``c2_score`` of rows of C1 that have no quality score yet; null where no answer gave one."""
    rows = hub.where("filters.C1 AND signals.c2_score IS NULL").select("id", "question", "choices", F.col("think").alias("cot"))
    rows = rows.withColumn("prompt", prompts.judge_prompt(F.col("question"), F.col("choices"), F.col("cot")))
    found = judged(rows, ["id"], call, J.quality_score, reps, tries, "double")
    return found.select("id", F.col("mean").alias("c2_score"))


def with_quality(hub: DataFrame, scores: DataFrame) -> DataFrame:
    """The hub with scores filled in where it has none."""
    rows = hub.join(scores.select("id", F.col("c2_score").alias("_q")), "id", "left")
    return rows.withColumn("signals", F.col("signals").withField("c2_score", F.coalesce("signals.c2_score", "_q"))).drop("_q")


def scored_until(
    rows: DataFrame, call: Callable[[DataFrame], DataFrame], failed: Column, position: str, limit: int = 8, batch: int = 1000
) -> tuple[DataFrame, bool]:
    """``call`` over batches of rows in the order of ``position``, until ``limit`` rows on end have failed.

    ``position`` numbers the rows from 0 without gaps.  Returns what was done, in whole batches up to the
    one in which it stopped and there up to the last of those failures, and whether it stopped.  Batches are
    written, so a driver that goes on later leaves out what they hold.
    """
    space = Workspace(rows.sparkSession, "until")
    n = rows.agg(F.max(position)).first()[0]
    done, before = None, 0  # failures on end at the end of the last batch
    for start in range(0, 0 if n is None else n + 1, batch):
        own = rows.where(F.col(position).between(start, start + batch - 1))
        found = space.save(call(own), f"batch-{start}")
        # a failure's run began behind the last success before it; one batch fits a task
        order = W.partitionBy(F.lit(0)).orderBy(position)
        fine = F.max(F.when(~failed, F.col(position))).over(order)
        length = F.col(position) - F.coalesce(fine, F.lit(start - 1 - before))
        runs = found.select(position, F.when(failed, length).otherwise(F.lit(0)).alias("run"))
        stop = runs.where(F.col("run") >= limit).agg(F.min(position)).first()[0]
        if stop is not None:
            found = found.where(F.col(position) <= stop)
        done = found if done is None else done.unionByName(found)
        if stop is not None:
            return done, True
        before = runs.agg(F.max_by("run", position)).first()[0] or 0
    return (call(rows.limit(0)) if done is None else done), False


def compared(
    samples: DataFrame, ref: Call, cand: Call, reuse: DataFrame | None = None, ref_only: bool = False, reps: int = 1, tries: int = 3,
    limit: int = 8, batch: int = 1000,
) -> tuple[DataFrame, bool]:
    """Two judges on the same texts: one row per text, and whether failures on end stopped the run.

    ``samples``: id, question, choices, answer, cot and ``cfs``, an array of (target_idx, cf_cot); those
    without a counterfactual text are left out.  ``reuse`` has the candidate's results of an earlier run
    (id, k, cand_score); with ``ref_only`` the candidate is not asked and its scores are null.  The
    original is k = -1.  A sample has failed if all calls of a judge for it failed.
    """
    texts = F.filter("cfs", lambda c: X.or_empty(c["cf_cot"]) != "")
    work = samples.withColumn("cfs", texts).where(F.size("cfs") > 0)
    places = numbered(work.select("id"), [], ["id"], "at")  # of ids alone, without their texts
    work = Workspace(samples.sparkSession, "compared").save(work.join(places, "id"), "work")

    def both(rows: DataFrame) -> DataFrame:
        shared = ["id", "at", "question", "choices"]
        items = rows.select(*shared, F.lit(-1).alias("k"), F.col("answer").cast("int").alias("target_idx"), "cot").unionByName(
            rows.select(*shared, F.posexplode("cfs").alias("k", "c")).select(
                *shared, "k", F.col("c.target_idx").cast("int").alias("target_idx"), F.col("c.cf_cot").alias("cot")
            )
        )
        key = ["id", "k"]
        side = lambda call, of, name: convincingness(of, key, call, reps, tries).select(
            *key, F.col("mean").alias(f"{name}_score"), F.array_min(F.transform("errors", lambda e: e.isNotNull())).alias(f"{name}_dead")
        )
        out = items.select(*key, "at", "target_idx").join(side(ref, items, "ref"), key)
        none = F.lit(None).cast("double").alias("cand_score"), F.lit(False).alias("cand_dead")
        if ref_only:
            return out.select("*", *none)
        asked = items if reuse is None else items.join(reuse.select("id").distinct(), "id", "left_anti")
        scores = side(cand, asked, "cand")
        if reuse is not None:
            scores = scores.unionByName(reuse.select(*key, "cand_score", F.lit(False).alias("cand_dead")))
        return out.join(scores, key, "left").withColumn("cand_dead", F.coalesce("cand_dead", F.lit(False)))

    def per_sample(rows: DataFrame) -> DataFrame:
        item = F.struct("k", "target_idx", "ref_score", "cand_score")
        return both(rows).groupBy("id", "at").agg(
            F.array_sort(F.collect_list(item)).alias("items"), (F.min("ref_dead") | F.min("cand_dead")).alias("dead")
        )

    done, stopped = scored_until(work, per_sample, F.col("dead"), "at", limit, batch)
    return done.select("id", F.explode("items").alias("x"), "dead").select("id", "x.*", "dead"), stopped
