import random

from helpers import docs, oracle, same

from tracemill.llm import line_dedup as L

LONG = "This line is certainly long enough to be counted as a key."


def brute(data, min_docs=5, min_chars=40):
    held = {}
    for i, text in data:
        for line in (text or "").encode().split(b"\n"):
            key = line.strip().lower()
            if len(key.decode()) >= min_chars:
                held.setdefault(key, set()).add(i)
    out = []
    for i, text in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(k := x.encode().strip().lower(), ())) >= min_docs and max(held[k], key=lambda j: -1 if j is None else j) != i)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=repr)


def test_oracle(spark, sf_small):
    same(L.op5_line_dedup(spark, sf_small).toPandas(), oracle(L.ORACLE, sf_small))


def test_batches_and_levels_against_brute_force(spark):
    rng = random.Random(4)
    lines = [f"{k} {LONG}" for k in range(30)] + ["", "short", "  " + LONG.upper() + "\t", LONG, "é" * 40, "é" * 39]
    data = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]
    for batches in (1, 4, 7):
        found = L.dedup_lines(docs(spark, *data, extra=True), batches=batches).collect()
        assert sorted([(r.doc_id, r.text or "") for r in found], key=repr) == brute(data)
        assert all(r.n_chars == len(r.text) for r in found if r.text is not None)


def ingested(spark, batches):
    from tracemill.llm.shared import Workspace

    runs = L.LineRuns(Workspace(spark, "test"), 4)
    for n, keys in enumerate(batches):
        runs.ingest(spark.createDataFrame([(10 * n + k, k, k) for k in keys], "__tm_doc long, __tm_h1 long, __tm_h2 long"))
    return runs


def totals(runs):
    return sorted((r["__tm_h1"], r.docs, r["last"]) for df in runs.totals() for r in df.collect())


BATCHES = [1, 2], [2, 3], [3, 4], [9, 1, 2], [2], [5]
WANT = [(1, 2, 31), (2, 4, 42), (3, 2, 23), (4, 1, 24), (5, 1, 55), (9, 1, 39)]


def test_runs_hold_each_key_once_and_compact(spark):
    runs = ingested(spark, BATCHES)
    assert [run is not None for run in runs.keys] == [False, True, True]  # six runs, merged two by two
    assert sorted(r["__tm_h1"] for run in runs.keys if run for r in run[1].collect()) == [1, 2, 3, 4, 5, 9]
    assert totals(runs) == WANT
    assert {r["__tm_h1"] for r in runs.hot(2, "hot").collect()} == {1, 2, 3}


def test_the_anti_join_decides(spark, monkeypatch):
    monkeypatch.setattr(L.LineRuns, "unknown", lambda self, batch: batch)
    assert totals(ingested(spark, BATCHES)) != WANT


def test_runs_are_neither_shuffled_nor_sorted(spark, capsys):
    runs = ingested(spark, BATCHES[:3])
    schema = "__tm_h1 long, __tm_h2 long, docs long, last long"
    with runs._in_order():
        batch = runs._write(spark.createDataFrame([(k, k, 1, 1) for k in range(99)], schema).repartition(4, *L.KEY), "batch")[1]
        one, other = (run[1] for run in runs.keys)
        for plan in (runs.unknown(batch), runs.merged(one, other, True), *runs.totals()):
            capsys.readouterr()
            plan.explain()
            text = capsys.readouterr().out
            assert "SortMergeJoin" in text and "Bucketed: true" in text
            assert "Exchange" not in text and "Sort [" not in text


def test_clashing_columns_stay(spark):
    from pyspark.sql import functions as F

    table = docs(spark, *[(i, LONG) for i in range(6)]).withColumn("__tm_doc", F.lit("mine")).withColumn("__TM_DROP", F.lit("too"))
    found = L.dedup_lines(table)
    assert found.columns == table.columns
    assert {(r["__tm_doc"], r["__TM_DROP"]) for r in found.collect()} == {("mine", "too")}
    assert sum(r.text == "" for r in found.collect()) == 5


def test_edges(spark):
    data = [(None, LONG), (None, LONG), (1, LONG), (1, LONG), (2, LONG + "\n" + LONG), (3, LONG), (4, LONG), (5, "x " * 300_000 + "\n" + LONG)]
    found = L.line_report(docs(spark, *data)).collect()
    assert len(found) == len(data)
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in found} == {(None, 1, 1), (1, 1, 1), (2, 2, 2), (3, 1, 1), (4, 1, 1), (5, 2, 0)}
    assert L.line_report(docs(spark, (1, "a")).limit(0)).collect() == []
