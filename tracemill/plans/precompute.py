"""Counterfactual texts and their scores, made by injected models and kept where a run may go on.

Good results are appended to a table under ``root``; a run leaves out what is there, so failures and what
a broken run did not reach are tried again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import counterfactual, scoring
from tracemill.operators.judging import Call, convincingness
from tracemill.schemas import CF_ITEM, LETTERS
from tracemill.workspace import Workspace, exists

RESULT = f"struct<k: int, orig_target_letter: string, orig_score: double, orig_judge_runs: array<int>, counterfactuals: array<{CF_ITEM}>, error: string>"


def _failed(k: int, error: str) -> Column:
    """The result of a sample that could not be worked on."""
    none = F.lit(None)
    return F.struct(F.lit(k), none.cast("string"), none.cast("double"), F.array().cast("array<int>"), F.array().cast(f"array<{CF_ITEM}>"), F.lit(error)).cast(RESULT)


def _kept(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root.rstrip('/')}/good"
    return spark.read.schema(f"id string, result {RESULT}").parquet(path) if exists(spark, path) else None


def _finished(samples: DataFrame, root: str, make: Callable[[DataFrame], DataFrame], good: Column, k: int) -> DataFrame:
    """``samples`` with ``counterfactual``: kept results, else new ones, of which the good ones are appended."""
    spark = samples.sparkSession
    done = _kept(spark, root)
    todo = samples if done is None else scoring.pending(samples, done, ["id"])
    new = Workspace(spark, "precompute").save(make(todo), "new")
    # read before good ones are appended, so that no result is there twice
    old = None if done is None else Workspace(spark, "precompute").save(done, "old")
    new.where(good).write.mode("append").parquet(f"{root.rstrip('/')}/good")
    results = new if old is None else new.unionByName(old)
    results = results.groupBy("id").agg(F.first("result").alias("counterfactual"))
    return samples.join(results, "id", "left").withColumn("counterfactual", F.coalesce("counterfactual", _failed(k, "not_processed")))


def precompute(
    spark: SparkSession, root: str, samples: DataFrame, regenerate: scoring.Scorer, judge: Call | None = None, k: int = 1,
    seed: int = 42, reps: int = 1, tries: int = 3,
) -> DataFrame:
    """``samples`` (id, question, choices, answer, cot) with ``k`` counterfactuals each, made and scored.

    ``regenerate`` argues for the option ``target_idx`` of a row and returns ``cf_cot`` and ``regen_model``.
    Without ``judge`` texts are made and not scored.  A sample without choices is an error.
    """

    def make(todo: DataFrame) -> DataFrame:
        space = Workspace(spark, "precompute")
        some = todo.where(F.size("choices") > 0)
        wrong = counterfactual.wrong_choices(F.col("id"), F.col("answer"), F.size("choices"), k, seed)
        rows = some.select("id", "question", "choices", F.posexplode(wrong).alias("pos", "target_idx"))
        texts = space.save(scoring.scored(rows, regenerate, "cf_cot string, regen_model string"), "texts")
        empty = F.when(X.or_empty(F.col("cf_cot")) == "", "empty_cot")
        texts = texts.withColumn("error", F.coalesce("error", empty))
        if judge is None:
            scores = spark.createDataFrame([], "id string, pos int, mean double, runs array<int>")
        else:
            shared = ["id", "pos", "question", "choices", "target_idx", "cot"]
            items = texts.where("error IS NULL").withColumn("cot", F.col("cf_cot")).select(*shared).unionByName(
                some.select("id", F.lit(-1).alias("pos"), "question", "choices", F.col("answer").alias("target_idx"), "cot").select(*shared)
            )
            scores = space.save(convincingness(items, ["id", "pos"], judge, reps, tries).select("id", "pos", "mean", "runs"), "scores")
        return assembled(some.select("id", "answer"), texts, scores, k).unionByName(
            todo.where(F.coalesce(F.size("choices"), F.lit(0)) <= 0).select("id", _failed(k, "empty_choices").alias("result"))
        )

    good = scoring.good_counterfactuals(F.col("result.counterfactuals")) & F.col("result.error").isNull()
    return _finished(samples, root, make, good, k)


def assembled(samples: DataFrame, texts: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``id`` and ``result`` from texts (id, pos, target_idx, cf_cot, regen_model, error) and scores (id, pos, mean, runs)."""
    letter = lambda i: F.substr(F.lit(LETTERS), i.cast("int") + 1, F.lit(1))
    rows = texts.join(scores, ["id", "pos"], "left")
    none = F.array().cast("array<int>")
    item = F.struct(
        F.col("target_idx").cast("int").alias("target_idx"), letter(F.col("target_idx")).alias("target_letter"), "cf_cot",
        F.col("mean").alias("cf_score"), F.coalesce("runs", none).alias("judge_runs"), "regen_model", "error",
    )
    # k items a sample
    each = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("r"))
    orig = scores.where("pos = -1").select("id", F.col("mean").alias("orig_score"), F.col("runs").alias("orig_runs"))
    out = samples.join(each, "id", "left").join(orig, "id", "left")
    result = F.struct(
        F.lit(k).alias("k"), letter(F.col("answer")).alias("orig_target_letter"), "orig_score",
        F.coalesce("orig_runs", none).alias("orig_judge_runs"),
        F.coalesce(F.transform("r", lambda x: x["item"]), F.array().cast(f"array<{CF_ITEM}>")).alias("counterfactuals"),
        F.lit(None).cast("string").alias("error"),
    )
    return out.select("id", result.cast(RESULT).alias("result"))


def judge_existing(
    spark: SparkSession, root: str, rows: DataFrame, judge: Call, reps: int = 1, tries: int = 3
) -> DataFrame:
    """Scores for counterfactuals that exist: ``rows`` come from ``counterfactual.assemble``, with an ``id``.

    A row without a wrong letter has the error ``missing_wrong_letter``; one without an original text has no
    original score.  A result is good if the counterfactual has a score, and the original too where it has a text.
    """

    def make(todo: DataFrame) -> DataFrame:
        space = Workspace(spark, "precompute")
        wrong = X.index_of_letter(F.col("wrong_letter"))
        texts = todo.select("id", F.lit(0).alias("pos"), wrong.alias("target_idx"), "cf_cot", F.lit("").alias("regen_model"))
        shared = ["id", "pos", "question", "choices", "target_idx", "cot"]
        items = todo.select("id", F.lit(0).alias("pos"), "question", "choices", wrong.alias("target_idx"), F.col("cf_cot").alias("cot"))
        items = items.where("target_idx IS NOT NULL").select(*shared).unionByName(
            todo.where("cot <> ''").select("id", F.lit(-1).alias("pos"), "question", "choices", F.col("answer").alias("target_idx"), "cot")
        )
        scores = space.save(convincingness(items, ["id", "pos"], judge, reps, tries), "scores")
        failure = scores.where("pos = 0 AND mean IS NULL").select("id", F.array_join("errors", "; ").alias("failure"))
        texts = texts.join(failure, "id", "left")
        error = F.when(F.col("target_idx").isNull(), "missing_wrong_letter").otherwise(F.col("failure"))
        texts = texts.withColumn("error", error).drop("failure")
        found = assembled(todo.select("id", "answer"), texts, scores.select("id", "pos", "mean", "runs"), 1)
        # an original that has a text and no score is an error too, so that the row is tried again
        found = found.join(todo.select("id", (F.col("cot") != "").alias("_has")), "id")
        error = F.when(F.col("_has") & F.col("result.orig_score").isNull(), "original not scored")
        return found.withColumn("result", F.col("result").withField("error", error)).drop("_has")

    good = F.try_element_at("result.counterfactuals", F.lit(1))["cf_score"].isNotNull() & F.col("result.error").isNull()
    return _finished(rows, root, make, good, 1)


def regenerated(rows: DataFrame, regenerate: scoring.Scorer) -> DataFrame:
    """Texts that argue for a given option (``target_idx``), with ``error`` for a failed call or an empty text."""
    out = scoring.scored(rows, regenerate, "cf_cot string, regen_model string")
    return out.withColumn("error", F.coalesce("error", F.when(X.or_empty(F.col("cf_cot")) == "", "empty_cot")))
