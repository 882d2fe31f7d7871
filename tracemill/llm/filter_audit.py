"""Interaction audit of document filters: every order of the filters, replayed on every document.

A document fails some of the filters.  Which of them removes it depends on the order in which they are
applied.  The flags of each document are crossed with a broadcast table of all orders (120 for five
filters), each pair is exploded into its steps, and the first failing step decides where the document
goes.  Counts are conditional sums by part, order and step.  They are combined in the tasks that
replay, so a part with a third of all rows sends no more rows than any other.  A filter's ``shapley``
is the number of documents that it removes, summed over all orders.

Copies are found without bringing equal texts together: the smallest id of each text's SHA-256 is
taken with map-side combining, and documents meet those ids by a join on (id, SHA-256), where an id is
hot only if rows repeat it.

Nulls: a null text is empty, a null part is the empty string, a null id is smaller than no id (it
neither makes a copy of another row nor is one) and has no labels.  Ties: rows that repeat the smallest
id of a text are all first.  Repeated rows count as often as they are there; several label rows of an
id count once, and any 1 among them holds.  Empty texts have no words: they are short, but their words
are not few of many and their letters not many of all.  Very long texts are read whole.  Columns are
selected by name, so extra ones may have any name.  Empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.once import once

from .shared import Workspace, table

#: The orders are broadcast: eight filters have 40 320, which is the bound.
MOST_FILTERS = 8


@dataclass(frozen=True)
class Limits:
    """Failing: fewer than ``least_words``, a smaller share of distinct words than ``distinct_percent``, a larger
    share of capitals than ``capital_percent``, or any of ``signs``."""

    least_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    signs: str = "#$%&*|"


def text_failures(docs: DataFrame, limits: Limits, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id``, ``part``, the text's SHA-256, and ``A`` to ``D``: whether the text fails that filter."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = once(rows, words=F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = once(rows, n=F.size("words"), kinds=F.size(F.array_distinct("words")))
    return rows.select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"),
        (F.col("n") < limits.least_words).alias("A"),
        (F.col("kinds") * F.lit(100) < F.col("n") * F.lit(limits.distinct_percent)).alias("B"),
        (F.regexp_count("text", F.lit("[A-Z]")) * F.lit(100) > F.length("text") * F.lit(limits.capital_percent)).alias("C"),
        F.col("text").rlike("[" + "".join(f"\\{s}" for s in limits.signs) + "]").alias("D"),
    )


def copies(rows: DataFrame, name: str = "E") -> DataFrame:
    """``rows`` with whether a row of a smaller ``doc_id`` has the same ``digest``."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL")
    # both sides grow with the documents: a sort-merge join at every size
    out = rows.join(first.hint("merge").withColumn("is_first", F.lit(True)), ["doc_id", "digest"], "left")
    return out.withColumn(name, F.col("doc_id").isNotNull() & F.col("is_first").isNull()).drop("is_first")


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """All orders of the filters' letters: ``filter_order`` and the ``steps`` as the letters' places in ``filters``."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders: {MOST_FILTERS} at most")
    found = [("".join(p), [filters.index(c) for c in p]) for p in permutations(filters)]
    return spark.createDataFrame(found, "filter_order string, steps array<int>")


def replay(flags: DataFrame, filters: str, lost: dict[str, Column] | None = None, part: str = "part") -> DataFrame:
    """Counts by part, order and step of documents with one boolean column for each letter of ``filters``.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), one count of removed documents for each condition in ``lost``,
    and ``shapley``: what the step's filter removes, summed over all orders.
    """
    lost = lost or {}
    mask = sum((F.when(F.col(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters)), F.lit(0)).cast("int")
    docs = flags.select(part, mask.alias("fails"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in lost.items()))
    pairs = docs.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    first = F.lit(len(filters) + 1)
    for step in reversed(range(len(filters))):
        fails = F.expr(f"(fails & shiftleft(1, steps[{step}])) != 0")
        first = F.when(fails, F.lit(step + 1)).otherwise(first)
    pairs = pairs.select("*", first.alias("first"))
    steps = pairs.select(part, "filter_order", "fails", *lost, "first", F.posexplode("steps").alias("at", "own"))
    step, own = F.col("at") + 1, F.expr("shiftleft(1, own)")
    fails, removed = F.col("fails").bitwiseAND(own) != 0, F.col("first") == step
    count = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(0).cast("long"))
    counts = steps.groupBy(part, "filter_order", step.cast("int").alias("step"), "own").agg(
        count(F.col("first") > step).alias("kept"), count(removed).alias("removed"),
        count(fails & (F.col("first") < step)).alias("redundant"), count(F.col("fails") == own).alias("unique_fails"),
        *(count(removed & F.col(n)).alias(n) for n in lost),
    )
    shapley = F.sum("removed").over(W.partitionBy(part, "own"))
    return counts.withColumn("shapley", shapley).drop("own")


def audit(
    docs: DataFrame, labels: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The replay of five filters over documents, with what each step loses of good and of toxic ones."""
    space = Workspace(docs.sparkSession, "filter-audit")
    rows = space.save(text_failures(docs, limits or Limits(), id_col, text_col, part_col), "rows")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    flags = copies(rows).join(known.hint("merge"), "doc_id", "left")
    return replay(flags, "ABCDE", {"good_lost": F.col("good") == 1, "toxic_lost": F.col("bad") == 1})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def oracle(limits: Limits | None = None) -> str:
    x = limits or Limits()
    sums = """count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
  count(*) FILTER (fails[own] AND first < step) AS redundant,
  count(*) FILTER (fails[own] AND len(list_filter(fails, lambda f: f)) = 1) AS unique_fails,
  count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND bad) AS toxic_lost"""
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least_id FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  [len(words) < {x.least_words}, 100 * len(list_distinct(words)) < {x.distinct_percent} * len(words),
   100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {x.capital_percent} * length(t),
   regexp_matches(t, '[{x.signs}]'), coalesce(w.doc_id > least_id, false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS steps FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
p AS (SELECT part, good, bad, fails, steps, list_aggregate(list_transform(steps, lambda s: chr(CAST(64 + s AS INT))), 'string_agg', '')
    AS filter_order, coalesce(list_position(list_transform(steps, lambda s: fails[s]), true), 6) AS first FROM d CROSS JOIN o),
s AS (SELECT part, good, bad, fails, filter_order, first, unnest(range(1, 6)) AS step, unnest(steps) AS own FROM p),
c AS (SELECT part, filter_order, CAST(step AS INT) AS step, own, {sums} FROM s GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""


ORACLE = oracle()
