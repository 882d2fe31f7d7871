"""Every registered query with its oracle.  Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import GapGate
from tracemill.functions import judge as J
from tracemill.functions import prompts
from tracemill.functions import text as X
from tracemill.operators import arms, calibration, counterfactual, gates, scoring, stats
from tracemill.plans.fixtures import Tables, with_views
from tracemill.sources import records
from tracemill.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAIRS = [("C3", "C1"), ("C2", "C3"), ("C_rand", "C0"), ("C3", "none")]


def query(oracle: str | None = None, *views: str):
    """Register a query of the tables, with the oracle's SQL and the views that it reads."""

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle, *views) if views else oracle
        return f

    return add


def _bank(t: Tables) -> DataFrame:
    b = t["fx_bank"]
    return b.select("subset", "sample_idx", "question", X.kept_choices("ch_a", "ch_b", "ch_c", "ch_d", "ch_e").alias("choices"), "gold")


def _hub(t: Tables) -> DataFrame:
    return arms.unified(t["fx_trace"], _bank(t))


def _signals(t: Tables) -> DataFrame:
    """One row per judged item: original score, gap and id."""
    cf = t["fx_cf"].groupBy("subset", "sample_idx").agg(F.max("orig_score").alias("orig"), F.collect_list("cf_score").alias("cfs"))
    return cf.select(
        records.record_id(F.col("subset"), F.col("sample_idx")).alias("id"), "subset", "sample_idx", "orig",
        counterfactual.gap(F.col("orig"), F.col("cfs")).alias("gap"), F.pmod("sample_idx", F.lit(7)).cast("double").alias("hedge_gap"),
    )


def _decided(t: Tables) -> DataFrame:
    gate = counterfactual.counterfactual_gate(F.col("orig"), F.array("best"), F.lit(None).cast("double"), GapGate(hedge=None))
    s = _signals(t).withColumn("best", F.col("orig") - F.col("gap"))
    return s.select("id", gate.passed.alias("passed"), gate.score.alias("gap"), F.col("orig").alias("orig_score"))


def _lazy_hub(t: Tables) -> DataFrame:
    """The hub with C3 and quality scores, without texts: a plan, for queries that read it once."""
    c2 = t["fx_c2"].select(records.record_id(F.col("subset"), F.col("sample_idx")).alias("id"), (F.col("c2_sum") / 3).alias("_q"))
    hub = arms.merge_c3(_hub(t), _decided(t)).join(c2, "id", "left")
    hub = hub.withColumn("signals", F.col("signals").withField("c2_score", F.col("_q")))
    return hub.select("id", "subject", "sample_idx", "has_think", "tokens", "filters", "signals", "gold", "final_answer")


def _scored_hub(t: Tables) -> DataFrame:
    """The same, written: for rankings, which read it several times.  What no ranking reads is not measured."""
    slim = _lazy_hub(t)
    signals = F.col("signals")
    slim = slim.withColumn("signals", F.struct(signals["gap"].alias("gap"), signals["c2_score"].alias("c2_score")))
    return Workspace(t.spark, "hub").save(slim, "scored")


def _with_texts(t: Tables, hub: DataFrame) -> DataFrame:
    """Rows of the hub with the texts that an export needs."""
    texts = t["fx_trace"].join(_bank(t).drop("gold"), ["subset", "sample_idx"]).select(
        records.record_id(F.col("subset"), F.col("sample_idx")).alias("id"), "question", "choices",
        X.think_text(F.col("reasoning_content"), F.col("reasoning")).alias("think"),
    )
    return hub.join(texts, "id")


def _results(t: Tables) -> DataFrame:
    return stats.last_results(t["fx_runs"].withColumn("is_correct", F.col("predicted") == F.col("gold")))


# What the oracles share.  Texts of the test tables have ASCII white space only.
_TOK = "list_filter(regexp_split_to_array(coalesce(d.text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
_ORDINARY = X.ORDINARY_CHARS.replace("'", "''")
_GARBAGE = f"length(regexp_replace(coalesce(d.text, ''), '[{_ORDINARY}]', '', 'g'))"
_THINK = "trim(coalesce(d.text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_ID = "printf('%s_%04d', {0}.subset, {0}.sample_idx)"
_C1 = f"""
c1 AS (SELECT t.doc_id, t.subset, t.sample_idx, {_ID.format('t')} AS id, t.predicted, b.gold, len({_TOK}) AS words,
  coalesce(t.predicted = substr('ABCDE', b.gold + 1, 1), false) AS correctness,
  {_THINK} <> '' AND NOT contains({_THINK}, '```') AND {_GARBAGE.replace("coalesce(d.text, '')", _THINK)} <= 0.15 * length({_THINK})
    AND coalesce(list_max(list_transform({_TOK}, lambda x: length(x))), 0) <= 200 AS readability,
  t.predicted IS NOT NULL AND {_THINK} <> '' AS format_parse, len({_TOK}) BETWEEN 20 AND 4000 AS length
  FROM fx_trace t JOIN fx_bank b ON t.subset = b.subset AND t.sample_idx = b.sample_idx JOIN documents d ON d.doc_id = t.doc_id)"""
_SIG = f"""
sig AS (SELECT {_ID.format('c')} AS id, c.subset, c.sample_idx, max(orig_score) AS orig, max(orig_score) - max(cf_score) AS gap
  FROM fx_cf c GROUP BY c.subset, c.sample_idx),
dec AS (SELECT *, CASE WHEN gap IS NULL THEN NULL WHEN orig < 2 THEN 'rej_minorig' WHEN gap < 1.5 THEN 'rej_gap' ELSE 'keep' END AS kind FROM sig)"""
_HUB = f"""
{_C1}, {_SIG},
hub AS (SELECT c1.*, correctness AND readability AND format_parse AND length AS f1,
  CASE WHEN NOT (correctness AND readability AND format_parse AND length) THEN false WHEN dec.id IS NOT NULL THEN coalesce(kind = 'keep', true) END AS f3,
  dec.gap, q.c2_sum / 3 AS c2
  FROM c1 LEFT JOIN dec ON c1.id = dec.id LEFT JOIN fx_c2 q ON q.subset = c1.subset AND q.sample_idx = c1.sample_idx)"""
_HUB_VIEWS = ("fx_trace", "fx_cf", "fx_c2")
_ITEMS = """
res AS (SELECT arm, seed, subset, sample_idx, CAST(coalesce(predicted = gold, false) AS INT) AS ok FROM (
 SELECT *, row_number() OVER (PARTITION BY arm, seed, subset, sample_idx ORDER BY pos DESC) AS r FROM fx_runs) WHERE r = 1),
items AS (SELECT arm, subset, sample_idx, sum(ok) AS r, count(*) AS s, sum(ok) / count(*) AS mean FROM res GROUP BY ALL),
common AS (SELECT items.* FROM items JOIN (SELECT arm, count(DISTINCT seed) AS a FROM res GROUP BY arm) USING (arm) WHERE s = a)"""
_RUNS = _ITEMS
#: The strict answer in SQL: the last answer line's letter, else the last A to E in the last 80 characters.
STRICT = (
    "coalesce(list_last(regexp_extract_all(coalesce({0}, ''), '정답[ \\t\\n\\r\\f\\v]*[:：][ \\t\\n\\r\\f\\v]*[(]?[ \\t\\n\\r\\f\\v]*([A-E])', 1)), "
    "nullif(regexp_extract(right(trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 80), '(?s).*([A-E])', 1), ''))"
)


# --- texts and gates


@query(
    f"SELECT d.doc_id, CAST(len({_TOK}) AS INT) AS words, CAST({_GARBAGE} AS INT) AS garbage, "
    f"CAST(coalesce(list_max(list_transform({_TOK}, lambda x: length(x))), 0) AS INT) AS longest, "
    f"CAST(len(list_filter({_TOK}, lambda x: regexp_matches(x, '[A-Za-z]{{2,}}'))) AS INT) AS latin FROM documents d"
)
def text_measures(t: Tables) -> DataFrame:
    d, text = t["documents"], F.col("text")
    latin = F.size(F.filter(X.tokens(text), lambda x: x.rlike("[A-Za-z]{2,}")))
    return d.select("doc_id", X.word_count(text).alias("words"), X.garbage_count(text).alias("garbage"), X.longest_run(text).alias("longest"), latin.alias("latin"))


@query(f"WITH {_C1} SELECT id, correctness, readability, format_parse, length, correctness AND readability AND format_parse AND length AS passed FROM c1", "fx_trace")
def c1_gates(t: Tables) -> DataFrame:
    h = _hub(t)
    return h.select("id", *(F.col(f"signals.c1.{g}").alias(g) for g in gates.GATES), F.col("filters.C1").alias("passed"))


@query(f"WITH {_C1} SELECT id, subset AS subject, CAST(gold AS INT) AS gold, predicted AS final_answer, CAST(words AS BIGINT) AS tokens FROM c1", "fx_trace")
def unified(t: Tables) -> DataFrame:
    return _hub(t).select("id", "subject", "gold", "final_answer", "tokens")


@query("SELECT count(*) AS n FROM fx_trace t WHERE NOT EXISTS (SELECT 1 FROM fx_bank b WHERE b.subset = t.subset AND b.sample_idx = t.sample_idx)", "fx_trace")
def unmatched_traces(t: Tables) -> DataFrame:
    return arms.unmatched(t["fx_trace"], _bank(t)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 6 = 0) AS differ, count(*) FILTER (doc_id % 6 = 0) * 20 > count(*) AS warn FROM fx_bank", "fx_bank")
def choices_audit(t: Tables) -> DataFrame:
    b = t["fx_bank"].select("subset", "sample_idx", F.array(*(F.coalesce(f"ch_{c}", F.lit("")) for c in "abcde")).alias("choices"))
    return arms.choices_mismatch(_bank(t), b)


@query(f"WITH {_C1} SELECT count(*) AS n, count(*) FILTER (NOT readability) AS rejected, count(*) FILTER (NOT readability) / count(*) AS rate FROM c1", "fx_trace")
def gate_rejection(t: Tables) -> DataFrame:
    return gates.rejection_rate(_hub(t), gates.Gate("readability", F.col("signals.c1.readability")))


@query(f"WITH {_C1} SELECT id, concat('readability:', CASE WHEN readability THEN 'ok' ELSE 'no' END, ',length:', CASE WHEN length THEN 'ok' ELSE 'no' END) AS history FROM c1 WHERE length", "fx_trace")
def gate_history(t: Tables) -> DataFrame:
    h = gates.judged(_hub(t), gates.Gate("readability", F.col("signals.c1.readability")))
    h = gates.passing(h, gates.Gate("length", F.col("signals.c1.length")))
    each = F.transform("filter_history", lambda r: F.concat(r["filter_name"], F.when(r["passed"], ":ok").otherwise(":no")))
    return h.select("id", F.array_join(each, ",").alias("history"))


@query(f"SELECT doc_id, {STRICT.format('raw')} AS strict FROM fx_text", "fx_text")
def parse_answer(t: Tables) -> DataFrame:
    return t["fx_text"].select("doc_id", X.parse_answer(F.col("raw")).alias("strict"))


@query(f"""WITH p AS (SELECT substr('ABCDE', CAST(doc_id % 3 AS INT) + 1, 1) AS gold, CASE WHEN doc_id % 4 = 0 THEN 'A' END AS old, {STRICT.format('raw')} AS new FROM fx_text)
SELECT count(*) AS n, count(*) FILTER (old = gold) AS old_right, count(*) FILTER (new = gold) AS new_right, count(*) FILTER (old IS NULL) AS old_null,
 count(*) FILTER (new IS NULL) AS new_null, count(*) FILTER (old IS DISTINCT FROM new) AS changed FROM p""", "fx_text")
def rescore_delta(t: Tables) -> DataFrame:
    gold = F.substr(F.lit("ABCDE"), (F.col("doc_id") % 3).cast("int") + 1, F.lit(1))
    old = F.when(F.col("doc_id") % 4 == 0, "A")
    return t["fx_text"].agg(*stats.rescore_delta(old, X.parse_answer_lenient(F.col("raw")), gold))


@query("""SELECT {0} AS id, '[Question]' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || '[Options]' || chr(10) || 'A. ' || ch_a || chr(10) || 'B. ' || ch_b
 || chr(10) || 'C. ' || ch_c || chr(10) || 'D. ' || ch_d || coalesce(chr(10) || 'E. ' || ch_e, '') AS block FROM fx_bank b""".format(_ID.format("b")), "fx_bank")
def question_block(t: Tables) -> DataFrame:
    return _bank(t).select(records.record_id(F.col("subset"), F.col("sample_idx")).alias("id"), X.question_block(F.col("question"), F.col("choices")).alias("block"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 1 + doc_id % 5 WHEN 1 THEN 1 + doc_id % 5 WHEN 2 THEN 1 + doc_id % 5 END::DOUBLE AS score,
 CASE WHEN doc_id % 8 = 0 THEN 'A' END AS letter FROM documents""")
def parse_judge_json(t: Tables) -> DataFrame:
    return t["fx_text"].select("doc_id", J.judge_score(F.col("raw")).alias("score"), J.judge_letter(F.col("raw")).alias("letter"))


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 5 THEN (1 + doc_id % 3 + 4.0::DOUBLE + 5) / 3 WHEN doc_id % 8 IN (0, 1, 2) THEN (1 + doc_id % 5)::DOUBLE END AS quality FROM documents""")
def composite_quality(t: Tables) -> DataFrame:
    return t["fx_text"].select("doc_id", J.quality_score(F.col("raw")).alias("quality"))


@query(
    "WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CAST("
    + " + ".join("(length(t) - length(replace(t, '{0}', ''))) // {1}".format(p.replace("'", "''"), len(p)) for p in (*X.KO_HEDGES, *X.EN_HEDGE_PHRASES))
    + " AS INT) AS phrases FROM low"
)
def hedge_phrases(t: Tables) -> DataFrame:
    low = F.lower(X.or_empty(F.col("text")))
    total = F.lit(0)
    for p in (*X.KO_HEDGES, *X.EN_HEDGE_PHRASES):
        total = total + X._occurrences(low, p)
    return t["documents"].select("doc_id", total.alias("phrases"))


@query("""SELECT lang, CAST(sum(CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM documents GROUP BY lang""")
def shard_filter(t: Tables) -> DataFrame:
    return records.in_shard(t["documents"].select(F.col("doc_id").alias("global_idx"), "lang"), (1, 4)).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 <> 0""")
def resume_antijoin(t: Tables) -> DataFrame:
    d = t["documents"].select("doc_id")
    return scoring.pending(d, d.where("doc_id % 3 = 0"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 5 END AS n FROM documents")
def choice_counts(t: Tables) -> DataFrame:
    return t["fx_bank"].select("doc_id", X.choice_count("ch_a", "ch_b", "ch_c", "ch_d", "ch_e").alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS sample_idx FROM documents")
def question_positions(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", F.col("lang").alias("subset"))
    return records.with_positions(rows, "doc_id").select("doc_id", "sample_idx")


@query("""WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents WHERE lang IN ('de', 'en', 'es'))
SELECT doc_id FROM p WHERE i < CASE lang WHEN 'de' THEN 34 ELSE 33 END""")
def balanced_limit(t: Tables) -> DataFrame:
    rows = records.with_positions(t["documents"].select("doc_id", F.col("lang").alias("subset")), "doc_id")
    return records.balanced_limit(rows, 100, ("de", "en", "es")).select("doc_id")


@query("""WITH s AS (SELECT lang, string_agg('[Question]' || chr(10) || 'q' || doc_id || chr(10) || chr(10) || '[Options]' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || '정답: B', chr(10) || chr(10) ORDER BY doc_id) AS shots
 FROM documents WHERE doc_id < 3 GROUP BY lang) SELECT doc_id, sha256('""" + prompts.STYLES["free"] + "' || chr(10) || chr(10) || '" + prompts.ANSWER_FORM + """' || chr(10) || chr(10) || coalesce(shots || chr(10) || chr(10), '')
 || '[Question]' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '[Options]' || chr(10) || 'A. ' || source || chr(10) || 'B. y') AS prompt
 FROM documents d LEFT JOIN s USING (lang)""")
def few_shot_prompts(t: Tables) -> DataFrame:
    d = t["documents"]
    examples = d.where("doc_id < 3").select(
        F.col("lang").alias("subset"), F.concat(F.lit("q"), F.col("doc_id")).alias("question"), F.array(F.lit("x"), F.lit("y")).alias("choices"),
        F.lit("B").alias("answer"), F.col("doc_id").alias("position"),
    )
    rows = d.join(prompts.few_shot_blocks(examples), d["lang"] == F.col("subset"), "left")
    text = prompts.prompt(F.col("text"), F.array("source", F.lit("y")), "free", F.col("shots"))
    return rows.select("doc_id", F.sha2(text, 256).alias("prompt"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 5 ELSE (doc_id % 5 + doc_id % 3) / 2 END AS mean FROM documents")
def mean_of_repeats(t: Tables) -> DataFrame:
    a, b, none = F.col("doc_id") % 5, F.col("doc_id") % 3, F.lit(None).cast("long")
    runs = F.when(F.col("doc_id") % 4 == 0, F.array(none)).when(F.col("doc_id") % 4 == 1, F.array(none, a)).otherwise(F.array(a, none, b))
    return t["documents"].select("doc_id", J.mean_of_valid(runs).alias("mean"))


# --- counterfactual signals


@query(f"WITH {_SIG} SELECT id, orig, gap FROM sig", "fx_cf")
def gap_signal(t: Tables) -> DataFrame:
    return _signals(t).select("id", "orig", "gap")


@query(f"""WITH {_SIG} SELECT id, CASE WHEN gap IS NULL THEN NULL WHEN orig < 2 THEN 'rej_minorig'
 WHEN gap < 1.5 AND sample_idx % 7 >= 3 THEN 'rej_gap' WHEN gap < 1.5 THEN 'rescued' ELSE 'keep' END AS kind FROM sig""", "fx_cf")
def cf_decision(t: Tables) -> DataFrame:
    return _signals(t).select("id", counterfactual.label(F.col("orig"), F.col("gap"), F.col("hedge_gap"), GapGate(hedge=3.0)).alias("kind"))


@query(f"WITH {_SIG} SELECT subset, coalesce(kind, 'missing') AS kind, count(*) AS n FROM dec GROUP BY ALL", "fx_cf")
def cf_decision_counts(t: Tables) -> DataFrame:
    kind = counterfactual.label(F.col("orig"), F.col("gap"), F.lit(None).cast("double"), GapGate(hedge=None))
    return _signals(t).select("subset", F.coalesce(kind, F.lit("missing")).alias("kind")).groupBy("subset", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, (SELECT i FROM (SELECT unnest(range(0, CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 5 END)) AS i) WHERE i <> gold
 ORDER BY md5('42:' || doc_id || ':' || i) LIMIT 1)::INT AS wrong FROM fx_bank""", "fx_bank")
def wrong_choice(t: Tables) -> DataFrame:
    n = F.when(F.col("ch_e").isNull(), 4).otherwise(5)
    return t["fx_bank"].select("doc_id", counterfactual.wrong_choices(F.col("doc_id"), F.col("gold"), n)[0].alias("wrong"))


@query("""SELECT doc_id, k, orig_score - cf_score AS gap, coalesce(orig_score < 2, false) OR coalesce(orig_score - cf_score < 1.5, false) AS "drop",
 CASE WHEN orig_score < 2 THEN 'orig<min' WHEN orig_score - cf_score < 1.5 THEN 'gap<thr' WHEN orig_score IS NULL OR cf_score IS NULL THEN 'missing' ELSE '' END AS reason
 FROM fx_cf""", "fx_cf")
def open_ended(t: Tables) -> DataFrame:
    return t["fx_cf"].select("doc_id", "k", counterfactual.open_ended(F.col("orig_score"), F.col("cf_score")).alias("r")).select("doc_id", "k", "r.*")


@query("""WITH r AS (SELECT orig_score - cf_score AS gap, coalesce(orig_score < 2, false) AS low FROM fx_cf)
SELECT count(*) AS n, avg(gap) AS mean, median(gap) AS median, min(gap) AS least, max(gap) AS most, count(*) FILTER (low OR gap < 1.5) AS dropped,
 count(*) FILTER (low) AS low, count(*) FILTER (NOT low AND gap < 1.5) AS small FROM r""", "fx_cf")
def open_ended_stats(t: Tables) -> DataFrame:
    return stats.open_ended_summary(open_ended(t))


@query("""SELECT c.doc_id, c.k, t.predicted, b.gold AS answer, sha256(b.question) AS question, substr('ABCDE', c.target_idx + 1, 1) AS wrong_letter,
 array_to_string([b.ch_a, b.ch_b, b.ch_c, b.ch_d, b.ch_e], '|') AS choices, sha256(CASE WHEN t.doc_id IS NULL THEN '' ELSE coalesce(o.cot, '') END) AS cot,
 sha256(CASE WHEN (c.doc_id + c.k) % 5 = 0 THEN o.text WHEN o.text <> '' THEN '<think>' || o.text || '</think>' || chr(10) || 'choice ' || c.k ELSE 'choice ' || c.k END) AS cf_cot
 FROM fx_cf c JOIN fx_bank b ON b.doc_id = c.doc_id JOIN fx_cot o ON o.doc_id = c.doc_id
 LEFT JOIN fx_trace t ON t.subset = c.subset AND t.sample_idx = c.sample_idx""", "fx_cf", "fx_trace", "fx_cot")
def cf_assembly(t: Tables) -> DataFrame:
    """Counterfactuals of documents' texts, with what traces and the bank know of their questions; without a final text for every fifth."""
    texts = t["fx_cot"].select("doc_id", "text", "cot")
    content = F.when((F.col("doc_id") + F.col("k")) % 5 == 0, "").otherwise(F.concat(F.lit("choice "), F.col("k").cast("string")))
    cf = t["fx_cf"].join(texts.drop("cot"), "doc_id").select(
        "subset", "sample_idx", F.lit(None).cast("string").alias("gold_letter"), F.lit("other").alias("question"),
        F.col("text").alias("cf_reasoning_content"), content.alias("cf_content"),
        F.concat_ws(":", F.substr(F.lit("ABCDE"), F.col("target_idx") + 1, F.lit(1)), "doc_id", "k").alias("wrong_letter"),
    )
    rows = counterfactual.assemble(cf, t["fx_trace"].join(texts.drop("text"), "doc_id"), _bank(t))
    parts, sha = F.split("wrong_letter", ":"), lambda c: F.sha2(c, 256).alias(c)
    return rows.select(
        parts[1].cast("long").alias("doc_id"), parts[2].cast("int").alias("k"), F.col("o_predicted").alias("predicted"), F.col("answer").cast("int").alias("answer"),
        sha("question"), parts[0].alias("wrong_letter"), F.array_join("choices", "|").alias("choices"), sha("cot"), sha("cf_cot"),
    )


# --- arms


_FLAGS = "count(*) FILTER (f1) AS \"C1\", count(*) FILTER (f3) AS \"C3\""


@query(f"""WITH {_HUB} SELECT coalesce(subset, 'ALL') AS subject, count(*) AS "C0", {_FLAGS}, 0 AS "C2", 0 AS "C_rand",
 count(*) FILTER (f1 AND f3 IS NOT NULL AND NOT f3) AS c1_not_c3 FROM hub GROUP BY ROLLUP (subset)""", *_HUB_VIEWS)
def arm_sizes(t: Tables) -> DataFrame:
    m = arms.arm_matrix(_lazy_hub(t))
    return m.withColumn("C2", F.col("C2").cast("int")).withColumn("C_rand", F.col("C_rand").cast("int"))


@query(f"WITH {_HUB} SELECT id, f1, f3 FROM hub", *_HUB_VIEWS)
def merge_c3(t: Tables) -> DataFrame:
    return _lazy_hub(t).select("id", F.col("filters.C1").alias("f1"), F.col("filters.C3").alias("f3"))


@query(f"""WITH {_HUB} SELECT id FROM hub WHERE f1 AND c2 IS NOT NULL ORDER BY c2 DESC, id LIMIT (SELECT count(*) FILTER (f3) FROM hub)""", *_HUB_VIEWS)
def merge_c2_topk(t: Tables) -> DataFrame:
    return arms.merge_c2(_scored_hub(t)).where("filters.C2").select("id")


@query(f"""WITH {_HUB} SELECT id FROM hub WHERE f1 ORDER BY md5('42:' || id), id LIMIT (SELECT count(*) FILTER (f3) FROM hub)""", *_HUB_VIEWS)
def make_crand(t: Tables) -> DataFrame:
    return arms.make_crand(_scored_hub(t)).where("filters.C_rand").select("id")


@query(f"""WITH {_HUB}, c AS (SELECT count(*) AS c0, count(*) FILTER (f1) AS c1, count(*) FILTER (f3) AS c3, count(*) FILTER (f1 AND f3) AS c13 FROM hub)
SELECT 'C0' AS a, 'C0' AS b, c0 AS n FROM c UNION ALL SELECT 'C0', 'C1', c1 FROM c UNION ALL SELECT 'C0', 'C3', c3 FROM c
UNION ALL SELECT 'C1', 'C1', c1 FROM c UNION ALL SELECT 'C1', 'C3', c13 FROM c UNION ALL SELECT 'C3', 'C3', c3 FROM c""", *_HUB_VIEWS)
def arm_overlap(t: Tables) -> DataFrame:
    return arms.overlaps(_lazy_hub(t), ("C0", "C1", "C3"))


@query(f"""WITH {_HUB}, r AS (SELECT NOT f1 AS x1, f1 AND NOT coalesce(c2 >= 4, false) AS x2, f1 AND NOT coalesce(f3, false) AS x3 FROM hub)
SELECT count(*) FILTER (x1) AS c1, count(*) FILTER (x2) AS c2, count(*) FILTER (x3) AS c3, count(*) FILTER (x2 AND x3) AS both,
 count(*) FILTER (x2 AND NOT x3) AS only_c2, count(*) FILTER (x3 AND NOT x2) AS only_c3 FROM r""", *_HUB_VIEWS)
def rejected_sets(t: Tables) -> DataFrame:
    hub = _lazy_hub(t).withColumn("filters", F.col("filters").withField("C2", F.col("signals.c2_score") >= 4))
    return arms.rejected_counts(arms.rejected_sets(hub))


@query(f"""WITH {_HUB} SELECT h.id, 2 AS messages, substr('ABCDE', h.gold + 1, 1) AS gold, coalesce(predicted, substr('ABCDE', h.gold + 1, 1)) AS answer_used,
 sha256(rtrim({_THINK}, ' ' || chr(10)) || chr(10) || '정답: ' || coalesce(predicted, substr('ABCDE', h.gold + 1, 1))) AS said
 FROM hub h JOIN documents d ON d.doc_id = h.doc_id WHERE f3""", *_HUB_VIEWS)
def sft_export(t: Tables) -> DataFrame:
    rows = arms.export_chat(_with_texts(t, _lazy_hub(t).where("filters.C3")), "C3", "Solve the question. Reason first, then answer on the last line.")
    return rows.select(F.col("meta.id").alias("id"), F.size("messages").alias("messages"), F.col("meta.gold").alias("gold"), F.col("meta.answer_used").alias("answer_used"), F.sha2(F.col("messages")[1]["content"], 256).alias("said"))


# --- sampling


_QUOTA = """
cnt AS (SELECT subset, count(*) AS c FROM hub WHERE f1 GROUP BY subset),
q AS (SELECT subset, c, 100 * c // sum(c) OVER () AS whole, 100 * c % sum(c) OVER () AS rest FROM cnt),
quota AS (SELECT subset, c, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c DESC, subset DESC) <= 100 - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


@query(f"WITH {_HUB}, {_QUOTA} SELECT subset AS subject, c AS \"count\", quota FROM quota", *_HUB_VIEWS)
def largest_remainder(t: Tables) -> DataFrame:
    return arms.largest_remainder(_lazy_hub(t).where("filters.C1").groupBy("subject").count(), 100)


@query(f"""WITH {_HUB}, {_QUOTA}, r AS (SELECT id, hub.subset AS subject, gap, row_number() OVER (PARTITION BY hub.subset ORDER BY gap DESC, id) <= quota AS inq
 FROM hub JOIN quota USING (subset) WHERE f1 AND gap IS NOT NULL) SELECT id, subject FROM r ORDER BY inq DESC, gap DESC, id LIMIT 100""", *_HUB_VIEWS)
def stratified_topn(t: Tables) -> DataFrame:
    return arms.low_data(_scored_hub(t), "C3", 100)


@query(f"WITH {_HUB} SELECT id, subset AS subject FROM hub WHERE f1 AND c2 IS NOT NULL ORDER BY c2 DESC, id LIMIT 50", *_HUB_VIEWS)
def low_data_c2(t: Tables) -> DataFrame:
    return arms.low_data(_lazy_hub(t), "C2", 50, stratified=False)


_EDGES = f"""
v AS (SELECT words, row_number() OVER (ORDER BY words) - 1 AS r, count(*) OVER () AS n FROM hub WHERE f1),
edges AS (SELECT i, words AS edge FROM (SELECT unnest(range(0, 21)) AS i) JOIN v ON r = least(n - 1, CAST(round_even(i * n / 20.0, 0) AS BIGINT)))"""


@query(f"WITH {_HUB}, {_EDGES} SELECT CAST(a.i AS INT) AS bin, CAST(a.edge AS BIGINT) AS lo, CAST(b.edge AS BIGINT) AS hi FROM edges a JOIN edges b ON b.i = a.i + 1", *_HUB_VIEWS)
def length_edges(t: Tables) -> DataFrame:
    return arms.quantile_edges(_scored_hub(t).where("filters.C1"))


@query(f"""WITH {_HUB}, {_EDGES}, p AS (SELECT id, coalesce(f3, false) AS t, CAST(coalesce((SELECT min(i) FROM edges e WHERE e.i > 0 AND hub.words <= e.edge) - 1, 19) AS INT) AS bin
 FROM hub WHERE f1), w AS (SELECT bin, count(*) FILTER (t) AS want FROM p GROUP BY bin),
 r AS (SELECT id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || id), id) AS r FROM p)
SELECT id, bin FROM r JOIN w USING (bin) WHERE r <= want""", *_HUB_VIEWS)
def length_matched(t: Tables) -> DataFrame:
    return arms.length_matched(_scored_hub(t), "C3")


@query(f"""WITH {_HUB}, s AS (SELECT subset, count(*) AS n FROM hub WHERE f3 GROUP BY subset)
SELECT count(*) AS n, sum(words) / count(*) AS mean_tokens, avg(gap) AS mean_gap, avg(c2) AS mean_c2,
 (SELECT '{{' || string_agg('"' || subset || '":' || n, ',' ORDER BY subset) || '}}' FROM s) AS subjects FROM hub WHERE f3""", *_HUB_VIEWS)
def selection_summary(t: Tables) -> DataFrame:
    rows = _lazy_hub(t).where("filters.C3")
    return arms.selection_summary(rows.select("subject", "tokens", F.col("signals.gap").alias("gap"), F.col("signals.c2_score").alias("c2_score")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY subset ORDER BY sample_idx) AS r FROM fx_bank) WHERE r <= 10", "fx_bank")
def balanced_head(t: Tables) -> DataFrame:
    return arms.balanced_head(t["fx_bank"].select("doc_id", "subset", "sample_idx"), 10).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def seeded_head(t: Tables) -> DataFrame:
    return arms.seeded_head(t["documents"].select("doc_id"), 25, key="doc_id")


# --- calibration


@query(f"""WITH {_SIG}, grid AS (SELECT * FROM (VALUES (1.0::DOUBLE), (1.5), (2.0)) g(g) CROSS JOIN (VALUES (NULL::DOUBLE), (0.5), (4.0)) h(h) CROSS JOIN (VALUES (NULL::DOUBLE), (2.0)) m(m)),
k AS (SELECT m, h, g, CASE WHEN gap IS NULL THEN 'none' WHEN m IS NOT NULL AND orig < m THEN 'rej_minorig' WHEN gap < g AND (h IS NULL OR sample_idx % 7 >= h) THEN 'rej_gap'
 WHEN gap < g THEN 'rescued' ELSE 'keep' END AS kind FROM sig CROSS JOIN grid),
c AS (SELECT m AS min_orig, h AS hedge, g AS gap, count(*) FILTER (kind = 'keep') AS keep, count(*) FILTER (kind = 'rescued') AS rescued, count(*) FILTER (kind = 'rej_gap') AS rej_gap,
 count(*) FILTER (kind = 'rej_minorig') AS rej_minorig FROM k GROUP BY ALL)
SELECT *, keep + rescued AS kept, rej_gap + rej_minorig AS rejected, (rej_gap + rej_minorig) / (keep + rescued + rej_gap + rej_minorig) AS rejected_share FROM c""", "fx_cf")
def threshold_sweep(t: Tables) -> DataFrame:
    return calibration.sweep(_signals(t), [1.0, 1.5, 2.0], [None, 0.5, 4.0], [None, 2.0])


@query(f"""WITH {_SIG}, r AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS r, count(*) OVER () AS n FROM sig WHERE gap IS NOT NULL)
SELECT q::DOUBLE AS q, gap AS "value" FROM r JOIN (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) AS q) ON r = least(n - 1, CAST(floor(q * (n - 1) + 0.5) AS BIGINT))""", "fx_cf")
def nearest_rank_quantiles(t: Tables) -> DataFrame:
    return calibration.nearest_ranks(_signals(t), "gap", [0, 0.25, 0.5, 0.75, 1])


OTSU = """
h AS (SELECT gap AS v, count(*) AS c FROM sig WHERE gap IS NOT NULL GROUP BY gap),
w AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(c) OVER (ORDER BY v) AS n0, sum(c * v) OVER (ORDER BY v) AS s0, sum(c) OVER () AS n, sum(c * v) OVER () AS s FROM h),
b AS (SELECT (v + nx) / 2 AS cut, (n0 / n) * ((n - n0) / n) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)) AS btw, CAST(n AS BIGINT) AS n FROM w WHERE nx IS NOT NULL)"""


@query(f"""WITH {_SIG}, {OTSU}
SELECT cut, n, round(btw / (SELECT sum(c * v * v) / sum(c) - (sum(c * v) / sum(c)) * (sum(c * v) / sum(c)) FROM h), 9) AS share FROM b ORDER BY btw DESC, cut LIMIT 1""", "fx_cf")
def otsu(t: Tables) -> DataFrame:
    return calibration.otsu(_signals(t), "gap").select("cut", "n", F.round("share", 9).alias("share"))


def _density(x: str, k: int) -> str:
    return f"w{k} * exp(-pow({x} - m{k}, 2) / (2 * v{k})) / sqrt(2 * pi() * v{k})"


#: Expectation and maximisation over the histogram, three hundred rounds of one row that holds the parameters.
MIXTURE = f"""
mh AS (SELECT gap AS v, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (ORDER BY gap) AS upto FROM sig WHERE gap IS NOT NULL GROUP BY gap),
ml AS (SELECT list(v ORDER BY v) AS vs, list(c ORDER BY v) AS cs, sum(c) AS n, sum(c * v) / sum(c) AS mean, CAST(count(*) AS BIGINT) AS k FROM mh),
mi AS (SELECT ml.*, greatest((SELECT sum(c * pow(v - ml.mean, 2)) FROM mh) / n, 1e-6) AS var, (SELECT min(v) FROM mh WHERE upto > n // 4) AS q1,
 (SELECT min(v) FROM mh WHERE upto > 3 * n // 4) AS q3 FROM ml),
em AS (SELECT 0 AS i, CAST(CASE WHEN q1 = q3 THEN mean - sqrt(var) ELSE q1 END AS DOUBLE) AS m0, CAST(CASE WHEN q1 = q3 THEN mean + sqrt(var) ELSE q3 END AS DOUBLE) AS m1,
  CAST(var AS DOUBLE) AS v0, CAST(var AS DOUBLE) AS v1, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1 FROM mi
 UNION ALL
 SELECT i + 1, m0, m1,
  greatest(list_sum(list_transform(range(1, k + 1), lambda j: p0[j] * pow(vs[j] - m0, 2))) / s0, 0.05),
  greatest(list_sum(list_transform(range(1, k + 1), lambda j: p1[j] * pow(vs[j] - m1, 2))) / s1, 0.05), s0 / n, s1 / n
 FROM (SELECT *, list_sum(list_transform(range(1, k + 1), lambda j: p0[j] * vs[j])) / s0 AS m0, list_sum(list_transform(range(1, k + 1), lambda j: p1[j] * vs[j])) / s1 AS m1
  FROM (SELECT *, greatest(list_sum(p0), 1e-12) AS s0, greatest(list_sum(p1), 1e-12) AS s1
   FROM (SELECT i, n, k, vs, list_transform(range(1, k + 1), lambda j: cs[j] * d0[j] / CASE WHEN d0[j] + d1[j] > 0 THEN d0[j] + d1[j] ELSE 1e-12 END) AS p0,
     list_transform(range(1, k + 1), lambda j: cs[j] * d1[j] / CASE WHEN d0[j] + d1[j] > 0 THEN d0[j] + d1[j] ELSE 1e-12 END) AS p1
    FROM (SELECT em.i, mi.n, mi.k, mi.vs, mi.cs, list_transform(mi.vs, lambda x: {_density('x', 0)}) AS d0, list_transform(mi.vs, lambda x: {_density('x', 1)}) AS d1
     FROM em, mi WHERE em.i < 300))))),
mf AS (SELECT CASE WHEN m0 <= m1 THEN m0 ELSE m1 END AS m0, CASE WHEN m0 <= m1 THEN m1 ELSE m0 END AS m1, CASE WHEN m0 <= m1 THEN v0 ELSE v1 END AS v0,
 CASE WHEN m0 <= m1 THEN v1 ELSE v0 END AS v1, CASE WHEN m0 <= m1 THEN w0 ELSE w1 END AS w0, CASE WHEN m0 <= m1 THEN w1 ELSE w0 END AS w1 FROM em WHERE i = 300),
mt AS (SELECT j, m0 + (m1 - m0) * j / 400 AS t, mf.* FROM mf, (SELECT unnest(range(0, 401)) AS j)),
md AS (SELECT j, t, {_density('t', 0)} - ({_density('t', 1)}) AS d FROM mt),
mx AS (SELECT t FROM (SELECT j, t, d, lag(d) OVER (ORDER BY j) AS e FROM md) WHERE d <= 0 AND e > 0 OR d >= 0 AND e < 0 ORDER BY j LIMIT 1),
mm AS (SELECT mf.*, CASE WHEN m1 > m0 THEN (SELECT t FROM mx) END AS crossover,
 -2 * list_sum(list_transform(range(1, k + 1), lambda j: cs[j] * ln(greatest(exp(-pow(vs[j] - mean, 2) / (2 * var)) / sqrt(2 * pi() * var), 1e-300)))) + 2 * ln(n) AS bic1,
 -2 * list_sum(list_transform(range(1, k + 1), lambda j: cs[j] * ln(greatest({_density('vs[j]', 0)} + {_density('vs[j]', 1)}, 1e-300)))) + 5 * ln(n) AS bic2,
 abs(m1 - m0) / sqrt((v0 + v1) / 2) AS separation FROM mf, mi)"""


@query(f"""WITH RECURSIVE {_SIG}, {MIXTURE} SELECT round(m0, 6) AS mu0, round(m1, 6) AS mu1, round(v0, 6) AS var0, round(v1, 6) AS var1, round(w0, 6) AS weight0, round(w1, 6) AS weight1,
 round(crossover, 6) AS crossover, round(bic1, 4) AS bic1, round(bic2, 4) AS bic2, round(separation, 6) AS separation FROM mm""", "fx_cf")
def gmm2(t: Tables) -> DataFrame:
    row = calibration.mixture(_signals(t), "gap")
    return row.select(*(F.round(c, 4 if c.startswith("bic") else 6).alias(c) for c in row.columns))


@query(f"WITH {_HUB} SELECT sig.id, orig, sig.gap FROM sig WHERE EXISTS (SELECT 1 FROM hub WHERE hub.id = sig.id AND f1)", *_HUB_VIEWS)
def restrict_to_c1(t: Tables) -> DataFrame:
    return calibration.restrict(_signals(t), _hub(t).where("filters.C1")).select("id", "orig", "gap")


@query("""WITH a AS (SELECT CASE arm WHEN 'C0' THEN 0.5 WHEN 'C1' THEN 1.0 WHEN 'C2' THEN 1.5 WHEN 'C3' THEN 2.0 ELSE 2.5 END::DOUBLE AS cut, avg(CAST(coalesce(predicted = gold, false) AS INT)) AS acc, min(seed) AS seed
 FROM fx_eval GROUP BY arm, seed),
c AS (SELECT cut, avg(acc) AS m, stddev_samp(acc) AS s FROM a GROUP BY cut), b AS (SELECT * FROM c ORDER BY m DESC, cut LIMIT 1), o AS (SELECT * FROM c WHERE cut = 1.5),
f AS (SELECT max(m) - min(m) AS spread, avg(s) AS noise FROM c)
SELECT round(spread, 9) AS spread, round(noise, 9) AS noise, b.cut AS best_cut, CASE WHEN spread <= greatest(noise, 1e-9) THEN 'flat' WHEN b.cut = 1.5 THEN 'same'
 WHEN b.m - o.m <= sqrt(b.s * b.s + o.s * o.s) THEN 'close' ELSE 'revisit' END AS verdict FROM f, b, o""", "fx_eval")
def verify_cuts(t: Tables) -> DataFrame:
    rows = t["fx_eval"].groupBy("arm", "seed").agg(
        F.avg(F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)).cast("int")).alias("accuracy")
    )
    cut = F.when(F.col("arm") == "C0", 0.5).when(F.col("arm") == "C1", 1.0).when(F.col("arm") == "C2", 1.5).when(F.col("arm") == "C3", 2.0).otherwise(2.5)
    rows = rows.select(cut.alias("cut"), "accuracy", (cut * 2).cast("int").alias("pos"))
    found = calibration.verify_cuts(rows, 1.5)
    return found.select(F.round("spread", 9).alias("spread"), F.round("noise", 9).alias("noise"), "best_cut", "verdict")


# --- statistics


@query(f"""WITH {_ITEMS}, a AS (SELECT arm, seed, sum(ok) / count(*) AS acc FROM res GROUP BY ALL)
SELECT arm, count(*) AS seeds, round(avg(acc), 9) AS mean, round(coalesce(stddev_samp(acc), 0), 9) AS std FROM a GROUP BY arm""", "fx_runs")
def seed_accuracy(t: Tables) -> DataFrame:
    return stats.seed_accuracy(_results(t)).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(f"WITH {_ITEMS} SELECT arm, subset, sample_idx, CAST(r AS BIGINT) AS \"right\", s AS seeds FROM common", "fx_runs")
def per_item_common(t: Tables) -> DataFrame:
    return stats.per_item(_results(t)).drop("mean")


@query("""WITH res AS (SELECT arm, subset, sample_idx, CAST(coalesce(predicted = gold, false) AS INT) AS ok FROM (
 SELECT *, row_number() OVER (PARTITION BY arm, seed, subset, sample_idx ORDER BY pos DESC) AS r FROM fx_runs WHERE predicted IS NOT NULL AND output_chars < 6000) WHERE r = 1)
SELECT arm, subset, sample_idx, CAST(sum(ok) AS BIGINT) AS "right", count(*) AS seeds FROM res GROUP BY ALL""", "fx_runs")
def per_item_union(t: Tables) -> DataFrame:
    e = stats.without_degenerate(t["fx_runs"]).withColumn("is_correct", F.col("predicted") == F.col("gold"))
    return stats.per_item(stats.last_results(e), common=False).drop("mean")


@query(f"WITH {_ITEMS} SELECT arm, subset, count(*) AS n, round(avg(mean), 9) AS acc FROM common GROUP BY ALL", "fx_runs")
def per_subject_acc(t: Tables) -> DataFrame:
    return stats.subject_accuracy(stats.per_item(_results(t))).withColumn("acc", F.round("acc", 9))


_CELLS = f"""{_ITEMS}, x AS (SELECT p.a, p.b, i.mean >= 0.5 AS x, j.mean >= 0.5 AS y FROM (VALUES ('C3', 'C1'), ('C2', 'C3'), ('C_rand', 'C0')) p(a, b)
 JOIN common i ON i.arm = p.a JOIN common j ON j.arm = p.b AND i.subset = j.subset AND i.sample_idx = j.sample_idx)"""


@query(f"""WITH {_CELLS} SELECT a, b, count(*) AS n, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_a,
 count(*) FILTER (y AND NOT x) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM x GROUP BY ALL""", "fx_runs")
def mcnemar_table(t: Tables) -> DataFrame:
    return stats.mcnemar_table(stats.per_item(_results(t)), PAIRS)


@query(f"""WITH {_CELLS}, n AS (SELECT a, b, count(*) FILTER (x AND NOT y) AS p, count(*) FILTER (y AND NOT x) AS q FROM x GROUP BY ALL)
SELECT a, b, CASE WHEN p + q = 0 THEN 'no_discordant' WHEN p + q < 25 THEN 'exact' ELSE 'chi2' END AS method,
 CASE WHEN p + q >= 25 THEN round(pow(greatest(abs(p - q) - 1, 0), 2) / (p + q), 6) END AS statistic FROM n""", "fx_runs")
def mcnemar_test(t: Tables) -> DataFrame:
    rows = stats.mcnemar(stats.mcnemar_table(stats.per_item(_results(t)), PAIRS))
    return rows.select("a", "b", "method", F.round("statistic", 6).alias("statistic"))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    return stats.bootstrap_interval(stats.per_item(_results(t)))


@query("""SELECT arm, subset, count(*) AS n, count(*) FILTER (predicted = gold) AS "right", count(*) FILTER (predicted IS NULL) AS unparsed,
 count(*) FILTER (predicted = gold) / count(*) AS acc FROM fx_eval GROUP BY arm, subset""", "fx_eval")
def eval_summary(t: Tables) -> DataFrame:
    return stats.accuracy(t["fx_eval"].withColumn("is_correct", F.col("predicted") == F.col("gold")), "arm", "subset")


@query("""WITH p AS (SELECT ref_letter AS a, cand_letter AS b FROM fx_judge WHERE cand_letter IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM p),
x AS (SELECT CAST(sum(ca * cb) AS BIGINT) AS x FROM (SELECT a AS l, count(*) AS ca FROM p GROUP BY a) JOIN (SELECT b AS l, count(*) AS cb FROM p GROUP BY b) USING (l))
SELECT n, same, x AS "cross", round((same / n - x / (n * n)) / (1 - x / (n * n)), 9) AS kappa FROM n, x""", "fx_judge")
def cohen_kappa(t: Tables) -> DataFrame:
    return stats.cohen_kappa(t["fx_judge"], "ref_letter", "cand_letter").withColumn("kappa", F.round("kappa", 9))


@query("""SELECT k, count(*) FILTER (cand_letter IS NOT NULL) AS n, count(*) FILTER (ref_letter = cand_letter) AS same,
 count(*) FILTER (ref_letter = cand_letter) / count(*) FILTER (cand_letter IS NOT NULL) AS rate FROM fx_judge GROUP BY k""", "fx_judge")
def agreement(t: Tables) -> DataFrame:
    return t["fx_judge"].groupBy("k").agg(*stats.agreement(F.col("ref_letter"), F.col("cand_letter")))


@query("""WITH r AS (SELECT ref_score < 3 AS a, cand_score < 3 AS b FROM fx_judge) SELECT count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (a AND b) AS both,
 count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND b) / count(*) FILTER (a OR b) AS jaccard FROM r""", "fx_judge")
def jaccard(t: Tables) -> DataFrame:
    return t["fx_judge"].agg(*stats.set_agreement(F.col("ref_score") < 3, F.col("cand_score") < 3))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY ref_score) + (count(*) OVER (PARTITION BY ref_score) - 1) / 2 AS x,
 rank() OVER (ORDER BY cand_score) + (count(*) OVER (PARTITION BY cand_score) - 1) / 2 AS y FROM fx_judge) SELECT count(*) AS n, round(corr(x, y), 9) AS rho FROM r""", "fx_judge")
def spearman(t: Tables) -> DataFrame:
    return stats.spearman(t["fx_judge"], "ref_score", "cand_score").withColumn("rho", F.round("rho", 9))


@query("""WITH c AS (SELECT doc_id % 20 AS g, cand_letter AS l, count(*) AS c, min(doc_id * 2 + k) AS p FROM fx_judge WHERE cand_letter IS NOT NULL GROUP BY ALL)
SELECT g, l AS mode FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, p) AS r FROM c) WHERE r = 1""", "fx_judge")
def mode_first(t: Tables) -> DataFrame:
    rows = t["fx_judge"].withColumn("g", F.col("doc_id") % 20).withColumn("p", F.col("doc_id") * 2 + F.col("k"))
    return stats.first_mode(rows, ["g"], "cand_letter", "p")


_EARLY = "SELECT doc_id, f.frac, doc_id % 10 < 3 + 5 * f.frac AS correct FROM {documents} CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS frac UNION ALL SELECT 0.25 UNION ALL SELECT 0.5 UNION ALL SELECT 1) f"


@query(f"""WITH e AS ({_EARLY.format(documents='documents')}), a AS (SELECT frac, avg(CAST(correct AS INT)) AS acc FROM e GROUP BY frac),
l AS (SELECT *, lag(frac) OVER (ORDER BY frac) AS f0, lag(acc) OVER (ORDER BY frac) AS a0, last_value(acc) OVER (ORDER BY frac ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM a)
SELECT round(arg_min(acc, frac), 9) AS floor, round(max(fin), 9) AS final, round(sum((frac - f0) * ((fin - a0) + (fin - acc)) / 2), 9) AS aoc,
 round(max(fin) - arg_min(acc, frac), 9) AS gain, round(arg_min(acc, frac) / max(fin), 9) AS "commit" FROM l""")
def early_answer_aoc(t: Tables) -> DataFrame:
    rows = t.spark.sql(_EARLY, documents=t["documents"])
    return stats.early_answer(rows).select(*(F.round(c, 9).alias(c) for c in ("floor", "final", "aoc", "gain", "commit")))


@query("""SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS subset, count(*) AS n, count(*) FILTER (doc_id % 19 = 0) AS errors,
 count(*) FILTER (doc_id % 19 <> 0 AND doc_id % 3 = 0) AS "right", count(*) FILTER (doc_id % 19 <> 0 AND doc_id % 7 <> 0) AS well_formed,
 CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(doc_id % 100) AS BIGINT) AS output_tokens, round((sum(n_chars) * 2.0 + sum(doc_id % 100) * 3.0) / 1e6, 9) AS cost
 FROM documents GROUP BY ROLLUP (lang)""")
def generation_summary(t: Tables) -> DataFrame:
    rows = t["documents"].select(
        F.col("lang").alias("subset"), F.when(F.col("doc_id") % 19 == 0, "e").alias("error"), (F.col("doc_id") % 3 == 0).alias("is_correct"),
        (F.col("doc_id") % 7 != 0).alias("well_formed"), F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 100).alias("output_tokens"),
    )
    return stats.generation_summary(rows, 2.0, 3.0).withColumn("cost", F.round("cost", 9))


@query(f"""WITH {_ITEMS}, a AS (SELECT arm, seed, sum(ok) / count(*) AS acc FROM res GROUP BY ALL), m AS (SELECT arm, avg(acc) AS m FROM a GROUP BY arm)
SELECT p.a, p.b, x.m > y.m AS holds FROM (VALUES ('C3', 'C1'), ('C2', 'C3'), ('C_rand', 'C0')) p(a, b) JOIN m x ON x.arm = p.a JOIN m y ON y.arm = p.b""", "fx_runs")
def hypothesis_rows(t: Tables) -> DataFrame:
    return stats.hypothesis_rows(stats.seed_accuracy(_results(t)), PAIRS).select("a", "b", "holds")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def language_histogram(t: Tables) -> DataFrame:
    return stats.histogram(t["documents"], "lang", "source")


@query("""SELECT avg(CAST(doc_id % 3 = 0 AS INT)) AS "without", avg(CAST(doc_id % 5 < 4 AS INT)) AS "with", avg(CAST(doc_id % 5 < 4 AS INT)) - avg(CAST(doc_id % 3 = 0 AS INT)) AS gain,
 avg(CAST(doc_id % 3 = 0 AS INT)) / avg(CAST(doc_id % 5 < 4 AS INT)) AS "commit" FROM documents""")
def reasoning_gain(t: Tables) -> DataFrame:
    return t["documents"].agg(*stats.reasoning_gain(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 < 4))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'orig' AS kind, -1 AS k, 'A' AS ds_supported_letter, 'B' AS cand_supported_letter FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'cf', i::INT, 'C', CASE WHEN i = 0 THEN 'C' ELSE 'D' END FROM documents, (SELECT unnest([0, 1]) AS i)""")
def judge_instances(t: Tables) -> DataFrame:
    item = lambda x: F.struct(F.lit(x).alias("supported_letter"), F.lit(True).alias("matches_target"), F.lit(1.0).alias("score"))
    side = lambda o, c: F.struct(item(o).alias("orig"), F.array(*map(item, c)).alias("cfs"))
    rows = t["documents"].select(F.col("doc_id").cast("string").alias("id"), side("A", "CC").alias("ds"), side("B", "CD").alias("cand"))
    return stats.judge_instances(rows).select("id", "kind", "k", "ds_supported_letter", "cand_supported_letter")


@query("""WITH r AS (SELECT count(*) FILTER (ref_letter = cand_letter) / count(*) FILTER (cand_letter IS NOT NULL) AS a, count(*) FILTER ((ref_score < 3) = (cand_score < 3)) / count(*) AS b FROM fx_judge)
SELECT coalesce(a >= 0.8 AND b >= 0.85, false) AS swap, abs(a - 0.8) <= 0.05 OR abs(b - 0.85) <= 0.05 AS borderline FROM r""", "fx_judge")
def judge_swap(t: Tables) -> DataFrame:
    j = t["fx_judge"]
    one = j.agg(stats.agreement(F.col("ref_letter"), F.col("cand_letter"))[2].alias("a"), (F.count_if((F.col("ref_score") < 3) == (F.col("cand_score") < 3)) / F.count(F.lit(1))).alias("b"))
    return one.select(stats.swap_verdict(F.col("a"), F.col("b"), F.lit(True)).alias("v")).select("v.*")


@query("SELECT count(DISTINCT doc_id) AS done FROM fx_cf", "fx_cf")
def done_count(t: Tables) -> DataFrame:
    return scoring.done_count(t["fx_cf"], ["doc_id"])
