"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves of the tree are (domain, language, source).  A token budget is divided from the root down by
integer weights.  No node gets more than its capacity: the tokens below it times ``max_epochs``.  What
a node cannot take goes to its siblings by their weights (water filling); only what all siblings
together cannot take was never given to their parent, and went to the parent's siblings instead.  So
shortages are settled among siblings before ancestors.  Budgets are whole tokens, rounded down.

A leaf uses all of its documents ``budget div tokens`` times.  The rest is the longest prefix, in the
seeded order of the next epoch, whose tokens fit.  The order is the MD5 of seed, epoch and id.  The
prefix is found by sums over 4096 hash ranges per leaf, and rows are ordered only within the one range
in which the rest ends, so a leaf with a third of all rows is spread over as many tasks.

Tokens are runs of anything but ASCII white space.  Nulls: a null text has no tokens, null languages
and sources are empty names, a null id is hashed as empty text.  Names without a weight have the
default's; weight 0 takes nothing.  Repeated rows are documents of their own with the same place in
the order.  Ties: siblings of equal ratios are filled in the order of their names, rows of one place in
that of tokens and id.  Very long texts are counted whole.  Columns are selected by name and renamed, so
extra ones may have any name.  An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Workspace

LEVELS = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level, a share of all tokens as the budget, and the epochs' seed."""

    domains: dict[str, str] = field(default_factory=lambda: DOMAINS)
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: WEIGHTS)
    default_weight: int = 1
    percent: int = 60
    max_epochs: int = 3
    seed: int = 7


DOMAINS = {f"src{i}": "web" if i < 10 else "reference" if i < 15 else "forum" for i in range(20)}
WEIGHTS = {
    "domain": {"web": 5, "reference": 3, "forum": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 1, "src1": 2},
}


def _named(names: dict[str, object], key: Column, default: Column) -> Column:
    out = default
    for name, value in names.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def token_table(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the leaf's names and the number of tokens."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    tokens = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _named(mix.domains, source, F.lit("other")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        tokens.cast("long").alias("tokens"),
    )


def divided(nodes: DataFrame, parents: list[str], level: str, mix: Mix) -> DataFrame:
    """``given`` for nodes with ``capacity`` and the parent's ``budget``: water filling among siblings."""
    weight = _named(mix.weights.get(level, {}), F.col(level), F.lit(mix.default_weight)).cast("long")
    nodes = nodes.withColumn("weight", weight)
    nodes = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long")))
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(-1.0))
    siblings = W.partitionBy(*(parents or [F.lit(0)]))
    order = siblings.orderBy(ratio, level)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    full = F.col("capacity") * after <= F.col("weight") * (F.col("budget") - before)
    nodes = nodes.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(siblings)
    nodes = nodes.withColumn("left", F.col("budget") - taken).withColumn("open", open_)
    share = F.expr("CASE WHEN full THEN capacity ELSE (weight * left) div greatest(open, 1) END")
    return nodes.withColumn("given", share)


def leaf_budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: its tokens and its budget."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("tokens").alias("size"))
    leaves = leaves.withColumn("capacity", F.col("size") * mix.max_epochs)
    for i in range(len(LEVELS)):
        path = LEVELS[: i + 1]
        own = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("size").alias("size"))
        if i:
            own = own.join(above, path[:-1])
        else:
            total = F.sum("size").over(W.partitionBy(F.lit(0)))
            own = own.withColumn("budget", F.expr(f"0L") + F.floor(total * mix.percent / F.lit(100)).cast("long"))
        above = divided(own, path[:-1], path[-1], mix).select(*path, F.col("given").alias("budget"))
    return leaves.select(*LEVELS, "size").join(above, LEVELS)


def mixed(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in the mix: ``doc_id``, leaf, ``tokens`` and ``copies``, how often each is used."""
    mix = mix or Mix()
    space = Workspace(docs.sparkSession, "mixing")
    tokens = space.save(token_table(docs, mix, id_col, text_col), "tokens")
    leaves = space.save(leaf_budgets(tokens, mix), "leaves").select(
        *LEVELS, F.expr("CASE WHEN size = 0 THEN 0 ELSE budget div size END").alias("epochs"),
        F.expr("CASE WHEN size = 0 THEN 0 ELSE budget % size END").alias("rest"),
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("epochs").cast("string"), F.lit(":"), name))
    rows = tokens.join(leaves, LEVELS).withColumn("place", place).withColumn("range", F.substr("place", F.lit(1), F.lit(3)))
    sums = rows.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("held"), F.first("rest").alias("limit"))
    upto = F.sum("held").over(W.partitionBy(*LEVELS).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = sums.withColumn("upto", upto)
    sums = space.save(sums.select(*LEVELS, "range", (F.col("upto") - F.col("held")).alias("before"), "upto"), "ranges")
    rows = rows.join(sums, [*LEVELS, "range"])
    inside = F.col("upto") <= F.col("rest")
    ends = ~inside & (F.col("before") <= F.col("rest"))
    some = W.partitionBy(*LEVELS, "range").orderBy("place", "tokens", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.where(ends).withColumn("reach", F.col("before") + F.sum("tokens").over(some))
    edge = edge.withColumn("more", (F.col("reach") <= F.col("rest")).cast("long"))
    rest = rows.where(~ends).withColumn("more", inside.cast("long"))
    out = ["doc_id", *LEVELS, "tokens", (F.col("epochs") + F.col("more")).alias("copies")]
    return edge.select(*out).unionAll(rest.select(*out)).where("copies > 0")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(names: dict[str, object], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in names.items()) + f" ELSE {default} END"


def _level_sql(i: int, mix: Mix) -> str:
    path, name = LEVELS[: i + 1], LEVELS[i]
    keys, above = ", ".join(path), ", ".join(path[:-1])
    by = f"PARTITION BY {above}" if i else ""
    budget = "b.given" if i else f"CAST(floor(sum(sum(size)) OVER () * {mix.percent} / 100.0) AS BIGINT)"
    join = f"JOIN g{i - 1} b USING ({above})" if i else ""
    group = ", b.given" if i else ""
    weight = _case(mix.weights.get(name, {}), name, str(mix.default_weight))
    return f"""
n{i} AS (SELECT {keys}, {budget} AS budget, {weight} AS weight,
  CASE WHEN {weight} > 0 THEN CAST(sum(capacity) AS BIGINT) ELSE 0 END AS capacity
  FROM leaves {join} GROUP BY {keys}{group}),
f{i} AS (SELECT *, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    weight * (budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_
  FROM n{i} WINDOW o AS ({by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE -1.0 END, {name})),
g{i} AS (SELECT {keys}, CAST(CASE WHEN full_ THEN capacity ELSE
    (weight * (budget - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER p)) //
    greatest(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER p, 1) END AS BIGINT) AS given
  FROM f{i} WINDOW p AS ({by}))"""


def oracle(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    keys = ", ".join(LEVELS)
    return f"""
WITH t AS (
  SELECT doc_id, {_case(mix.domains, 'source', "'other'")} AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT {keys}, CAST(sum(tokens) AS BIGINT) AS size, CAST(sum(tokens) * {mix.max_epochs} AS BIGINT) AS capacity
  FROM t GROUP BY {keys}),
{','.join(_level_sql(i, mix) for i in range(len(LEVELS)))},
b AS (SELECT {keys}, CASE WHEN size = 0 THEN 0 ELSE given // size END AS epochs,
  CASE WHEN size = 0 THEN 0 ELSE given % size END AS rest FROM leaves JOIN g{len(LEVELS) - 1} USING ({keys})),
r AS (SELECT t.*, epochs, rest, sum(tokens) OVER (PARTITION BY {keys}
    ORDER BY md5('{mix.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), tokens, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM t JOIN b USING ({keys}))
SELECT doc_id, {keys}, tokens, CAST(epochs + CASE WHEN reach <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r WHERE epochs + CASE WHEN reach <= rest THEN 1 ELSE 0 END > 0
"""


ORACLE = oracle()
