"""The hub table, comparison arms cut from it, and samples of equal size or length.

Selections are by the MD5 of seed and id: exact in size, the same on any cluster and partitioning.
Rankings carry only ids and scores; texts are joined back to what was chosen.  Building a plan runs
nothing: sizes and edges are rows that the plan computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.config import RuleGates
from tracemill.functions import text as X
from tracemill.operators.gates import measured, passes_all, rule_verdicts
from tracemill.operators.once import first_by_hash, first_ids, pinned, running
from tracemill.schemas import ARMS
from tracemill.sources.records import record_id

KEY = ["subset", "sample_idx"]


def unified(traces: DataFrame, bank: DataFrame, limits: RuleGates = RuleGates()) -> DataFrame:
    """Traces with their questions: verdicts, tokens, English share, and one flag per arm.

    ``bank`` has ``gold`` as a 0-based number and ``choices``.  Traces without a question are left out;
    ``unmatched`` counts them.
    """
    rows = traces.join(bank.select(*KEY, "question", "choices", "gold"), KEY)
    rows, m = measured(pinned(rows, think=X.think_text(F.col("reasoning_content"), F.col("reasoning"))), "think")
    gold = F.substr(F.lit("ABCDE"), F.col("gold") + 1, F.lit(1))
    c1 = rule_verdicts(m, F.col("predicted"), gold, limits)
    spoken = F.when(m["chars"] > 0, X.language_of(X.shares_of(m["hangul_letters"], m["latin_letters"])))
    none = F.lit(None).cast("boolean")
    flags = {"C0": F.lit(True), "C1": passes_all(c1), "C2": none, "C3": none, "C_rand": none}
    return rows.select(
        record_id(F.col("subset"), F.col("sample_idx")).alias("id"), F.col("subset").alias("subject"), "sample_idx",
        "question", "choices", F.col("gold").cast("int").alias("gold"), "think", (m["chars"] > 0).alias("has_think"),
        X.letter(F.col("predicted")).alias("final_answer"), m["words"].cast("long").alias("tokens"),
        F.bround(F.when(m["words"] > 0, m["latin"] / m["words"]).otherwise(0.0), 4).alias("en_ratio"),
        F.struct(*(flags[a].alias(a) for a in ARMS)).alias("filters"),
        F.struct(
            c1.alias("c1"), (F.col("think_lang") if "think_lang" in rows.columns else spoken).alias("think_lang"),
            F.lit(None).cast("double").alias("c2_score"), F.lit(None).cast("double").alias("gap"),
            F.lit(None).cast("double").alias("orig_score"),
        ).alias("signals"),
    )


def unmatched(traces: DataFrame, bank: DataFrame) -> DataFrame:
    return traces.join(bank.select(*KEY), KEY, "left_anti")


def choices_mismatch(left: DataFrame, right: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Matched rows, rows whose choices differ, and whether these are over a twentieth."""
    both = left.select(*key, F.col("choices").alias("a")).join(right.select(*key, F.col("choices").alias("b")), key)
    out = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
    return out.withColumn("warn", F.col("differ") * 20 > F.col("n"))


def merge_c3(hub: DataFrame, decided: DataFrame) -> DataFrame:
    """``C3`` from (``id``, ``passed``, ``gap``, ``orig_score``): failing C1 is false, unjudged is null."""
    d = decided.select("id", F.col("passed").alias("_p"), F.col("gap").alias("_g"), F.col("orig_score").alias("_o"), F.lit(True).alias("_seen"))
    rows = hub.join(d, "id", "left")
    flag = F.when(~F.col("filters.C1"), F.lit(False)).when(F.col("_seen"), F.col("_p"))
    rows = rows.withColumn("filters", F.col("filters").withField("C3", flag))
    signals = F.col("signals").withField("gap", F.col("_g")).withField("orig_score", F.col("_o"))
    return rows.withColumn("signals", signals).drop("_p", "_g", "_o", "_seen")


def size_of(hub: DataFrame, arm: str) -> DataFrame:
    return hub.agg(F.count_if(F.col(f"filters.{arm}")).alias("n"))


def _chosen(hub: DataFrame, chosen: DataFrame, arm: str) -> DataFrame:
    """Sets an arm's flag: true for chosen ids, false for all others."""
    c = chosen.select("id", F.lit(True).alias("_in"))
    rows = hub.join(c, "id", "left")
    return rows.withColumn("filters", F.col("filters").withField(arm, F.coalesce("_in", F.lit(False)))).drop("_in")


def c2_ids(hub: DataFrame) -> DataFrame:
    """As many of C1 as C3 holds, by general quality score, ties by id; none without C3 or scores."""
    pool = hub.where("filters.C1 AND signals.c2_score IS NOT NULL").select("id", F.col("signals.c2_score").alias("s"))
    return first_ids(pool, size_of(hub, "C3"), -F.col("s"), "id")


def crand_ids(hub: DataFrame, seed: int = 42) -> DataFrame:
    """As many of C1 as C3 holds, by hash of seed and id."""
    pool = hub.where("filters.C1").select("id", by_hash(seed, F.col("id")).alias("h"))
    return first_by_hash(pool, size_of(hub, "C3"))


def merge_c2(hub: DataFrame) -> DataFrame:
    """``C2`` of a hub, which should be written: rankings read it several times."""
    return _chosen(hub, c2_ids(hub), "C2")


def make_crand(hub: DataFrame, seed: int = 42) -> DataFrame:
    """``C_rand`` of a hub, which should be written."""
    return _chosen(hub, crand_ids(hub, seed), "C_rand")


def merge_ranked(hub: DataFrame, seed: int = 42) -> DataFrame:
    """``C2`` and ``C_rand``, both ranked on the hub as it is: one after the other would read the first for each scan of the second."""
    return _chosen(_chosen(hub, c2_ids(hub), "C2"), crand_ids(hub, seed), "C_rand")


def by_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def overlaps(hub: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Sizes of all pairs' intersections; an arm with itself gives its size."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i:]]
    counts = hub.agg(*(F.count_if(F.col(f"filters.{a}") & F.col(f"filters.{b}")).alias(f"{a}|{b}") for a, b in pairs))
    return counts.select(
        F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("n")) for a, b in pairs))).alias("x")
    ).select("x.*")


def export_chat(hub: DataFrame, arm: str, instruction: str) -> DataFrame:
    """Two messages and a few facts for each row of an arm; rows without reasoning are left out."""
    gold = F.substr(F.lit("ABCDE"), F.col("gold") + 1, F.lit(1))
    used = F.coalesce("final_answer", gold)
    asked = F.concat(F.lit(f"{instruction}\n\n"), X.question_block(F.col("question"), F.col("choices")))
    said = F.concat(X.without_trailing_answer(F.col("think")), F.lit(f"\n{X.ANSWER_WORD}: "), used)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = hub.where(F.col(f"filters.{arm}") & (X.strip(X.or_empty(F.col("think"))) != "") & used.isNotNull())
    return rows.select(
        F.array(message("user", asked), message("assistant", said)).alias("messages"),
        F.struct("id", F.col("subject"), gold.alias("gold"), used.alias("answer_used")).alias("meta"),
    )


def largest_remainder(counts: DataFrame, n: int, name: str = "subject", count: str = "count") -> DataFrame:
    """``quota`` by share of ``count``: whole parts, then one more by fraction, count and name, all descending.

    One row per stratum: the windows below see only these.
    """
    rows = counts.withColumn("_all", F.sum(count).over(W.partitionBy(F.lit(0))))
    rows = rows.withColumn("quota", F.expr(f"(cast({n} as bigint) * `{count}`) div _all"))
    rows = rows.withColumn("_rest", F.expr(f"(cast({n} as bigint) * `{count}`) % _all"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.desc(count), F.desc(name)))
    left = F.lit(n) - F.sum("quota").over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("_more", (rank <= left).cast("long"))
    return rows.select(name, count, (F.col("quota") + F.col("_more")).alias("quota"))


def stratified_top(ranked: DataFrame, quotas: DataFrame, n: int, fill: bool = True) -> DataFrame:
    """The best of each subject up to its quota; a shortfall is filled from the rest of the ranking.

    ``ranked`` has ``id``, ``subject`` and ``place``, an expression of order with smaller first.
    """
    # no row beyond the n-th of its subject can be chosen, so tasks drop those before any shuffle
    each = W.partitionBy("subject").orderBy("place", "id")
    rows = ranked.withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= n).join(F.broadcast(quotas.select("subject", "quota")), "subject")
    rows = rows.withColumn("_in", F.col("_r") <= F.col("quota"))
    if not fill:
        return rows.where("_in").select("id", "subject")
    # all that are within a quota come first: the first n of this order are the quotas, then the best others
    return rows.orderBy(F.desc("_in"), "place", "id").limit(n).select("id", "subject")


def low_data(hub: DataFrame, arm: str, n: int, seed: int = 42, stratified: bool = True) -> DataFrame:
    """``n`` rows of C1 for an arm: by gap, by quality score, or by hash; stratified by subject if asked."""
    pool = hub.where("filters.C1 AND has_think")
    place = {"C3": -F.col("signals.gap"), "C2": -F.col("signals.c2_score"), "C_rand": by_hash(seed, F.col("id"))}[arm]
    ranked = pool.select("id", "subject", place.alias("place")).where("place IS NOT NULL")
    if not stratified:
        return ranked.orderBy("place", "id").limit(n).select("id", "subject")
    return stratified_top(ranked, largest_remainder(pool.groupBy("subject").count(), n), n, fill=arm != "C_rand")


def quantile_edges(values: DataFrame, bins: int = 20, value: str = "tokens") -> DataFrame:
    """``bin``, ``lo``, ``hi``: edges at half-even rounded ranks, found on the histogram of values."""
    hist = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    hist = running(hist, "v", {"upto": F.col("c")}).withColumnRenamed("upto_all", "n")
    at = lambda i: F.least(F.col("n") - 1, F.bround(i * F.col("n") / F.lit(float(bins))).cast("long"))
    # a value is the edge of the ranks that its rows take
    ranks = F.filter(F.sequence(F.lit(0), F.lit(bins)), lambda i: (F.col("upto") > at(i)) & (F.col("upto") - F.col("c") <= at(i)))
    edge = hist.select(F.explode(ranks).alias("bin"), F.col("v").alias("lo"))
    every = edge.agg(F.map_from_entries(F.collect_list(F.struct("bin", "lo"))).alias("edges"))  # one row of bins + 1 edges
    return edge.where(F.col("bin") < bins).crossJoin(F.broadcast(every)).select("bin", "lo", F.col("edges")[F.col("bin") + 1].alias("hi"))


def bin_of(value: Column, edges: Column) -> Column:
    """The first bin whose upper edge is not below the value, else the last; ``edges`` are the upper ones."""
    found = F.array_position(F.transform(edges, lambda e: value <= e), True)
    return F.when(found > 0, found - 1).otherwise(F.size(edges) - 1).cast("int")


def length_matched(hub: DataFrame, target: str, bins: int = 20, seed: int = 42) -> DataFrame:
    """Ids of C1 with the target arm's distribution over bins of length, within a bin by hash."""
    pool = hub.where("filters.C1 AND tokens > 0").select("id", "tokens", F.coalesce(f"filters.{target}", F.lit(False)).alias("t"))
    edges = quantile_edges(pool, bins).agg(F.array_sort(F.collect_list(F.struct("bin", "hi")))["hi"].alias("edges"))  # one row
    pool = pool.crossJoin(F.broadcast(edges)).withColumn("bin", bin_of(F.col("tokens"), F.col("edges")))
    wanted = pool.where("t").groupBy("bin").agg(F.count(F.lit(1)).alias("want"))
    rows = pool.select("id", "bin", by_hash(seed, F.col("id")).alias("h")).withColumn("_range", F.left("h", F.lit(3)))
    counts = rows.groupBy("bin", "_range").agg(F.count(F.lit(1)).alias("c"))  # 4096 rows a bin at most
    upto = F.sum("c").over(W.partitionBy("bin").orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumn("upto", upto).join(F.broadcast(wanted), "bin").where("upto - c < want")
    rows = rows.join(F.broadcast(counts), ["bin", "_range"])
    edge = rows.where("upto > want")  # a bin is put in order only within the one range in which its share ends
    edge = edge.withColumn("r", F.row_number().over(W.partitionBy("bin", "_range").orderBy("h", "id"))).where("upto - c + r <= want")
    return rows.where("upto <= want").select("id", "bin").unionByName(edge.select("id", "bin"))


def selection_summary(rows: DataFrame) -> DataFrame:
    """Size, means of tokens, gap and quality, and rows by subject as JSON."""
    each = rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum("gap").alias("g"), F.count("gap").alias("gn"),
        F.sum("c2_score").alias("q"), F.count("c2_score").alias("qn"),
    )
    return each.agg(
        F.sum("n").alias("n"), (F.sum("t") / F.sum("n")).alias("mean_tokens"),
        F.expr("try_divide(sum(g), sum(gn))").alias("mean_gap"), F.expr("try_divide(sum(q), sum(qn))").alias("mean_c2"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", "n"))))).alias("subjects"),
    )


def rejected_sets(hub: DataFrame) -> DataFrame:
    """Who rejects which rows: C1's rejects; among C1's passes C2's and C3's, where null rejects too."""
    c = lambda a: F.coalesce(F.col(f"filters.{a}"), F.lit(False))
    return hub.select(
        "id", "subject", (~c("C1")).alias("by_c1"), (c("C1") & ~c("C2")).alias("by_c2"), (c("C1") & ~c("C3")).alias("by_c3"),
        F.coalesce("signals.gap", F.lit(99.0)).alias("gap_order"), F.coalesce("signals.c2_score", F.lit(99.0)).alias("c2_order"),
    )


def rejected_counts(sets: DataFrame) -> DataFrame:
    return sets.agg(
        F.count_if("by_c1").alias("c1"), F.count_if("by_c2").alias("c2"), F.count_if("by_c3").alias("c3"),
        F.count_if(F.col("by_c2") & F.col("by_c3")).alias("both"),
        F.count_if(F.col("by_c2") & ~F.col("by_c3")).alias("only_c2"), F.count_if(F.col("by_c3") & ~F.col("by_c2")).alias("only_c3"),
    )


def balanced_head(rows: DataFrame, n: int, group: str = "subset", position: str = "sample_idx") -> DataFrame:
    """The first ``n`` rows of each group by position."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(position))).where(F.col("_r") <= n).drop("_r")


def seeded_head(rows: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows in an order by hash."""
    return rows.orderBy(by_hash(seed, F.col(key)), key).limit(n)


def arm_matrix(hub: DataFrame) -> DataFrame:
    """Arm sizes by subject with a total (``ALL``), and rows that C1 takes and C3 rejects (null is not rejected)."""
    flag = lambda a: F.count_if(F.col(f"filters.{a}")).alias(a)
    h1 = F.count_if(F.col("filters.C1") & F.col("filters.C3").eqNullSafe(F.lit(False))).alias("c1_not_c3")
    rows = hub.rollup("subject").agg(F.grouping("subject").alias("_g"), *(flag(a) for a in ARMS), h1)
    return rows.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("subject")).alias("subject"), *ARMS, "c1_not_c3")
