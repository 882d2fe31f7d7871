"""A training corpus in stages: each works on all that its predecessor kept.

Nulls: a document without a text or an id goes through all stages as an empty one: it is scored as an empty
text, is near nothing, holds no passage, and has no tokens to mix.  Empty and very long texts are worked on
whole.  Ties: of near duplicates the smallest id stays, of shared lines the largest id's.  Repeated rows of one
id are judged alike by each stage; the Jaccard stage keeps those of the id that stays.  Columns beside those of
``documents``, of whatever names, stay until the mix, which has columns of its own.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from tracemill.llm.shared import Workspace, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labelled ones among them, does not find toxic."""
    return toxicity.keep_clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more of them share; the largest id keeps them."""
    return line_dedup.dedup_lines(docs)


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark passages."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of domains, languages and sources uses, and how often it uses each."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Training a classifier is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a table in the shared folder stands between two stages."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.save(docs, name)
    return docs
