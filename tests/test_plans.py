"""Drivers composed over injected models: they resume, retry, stop, and leave what the plain rules say."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.__main__ import main
from tracemill.operators import judging, scoring
from tracemill.operators.models import scorer
from tracemill.plans import evaluation, precompute
from tracemill.sources import records
from tracemill.workspace import exists, read_text, write_text

ANSWERS = {"good": '{"supported_letter": "A", "score": 4}', "empty": "  ", "prose": "no verdict"}


def test_repetitions_tries_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in (*ANSWERS, "dead", "late")], "id string")
    log = str(tmp_path)

    def call(row):
        with open(f"{log}/{row['id']}-{row['rep']}", "a") as f:
            f.write("x")
        calls = len(open(f"{log}/{row['id']}-{row['rep']}").read())
        if row["id"] == "dead":
            raise RuntimeError("no")
        if row["id"] == "late":
            return ANSWERS["good"] if calls == 3 else ""
        return ANSWERS[row["id"]]

    found = {r.id: r for r in judging.judged(rows, ["id"], call, reps=2).collect()}
    assert (found["good"].runs, found["good"].mean, found["good"].errors) == ([4, 4], 4.0, [None, None])
    assert (found["empty"].runs, found["empty"].mean, found["empty"].errors) == ([], None, ["empty_response"] * 2)
    assert found["prose"].errors == ["parse_failed"] * 2 and found["prose"].raws == ["no verdict"] * 2
    assert found["dead"].errors == ["RuntimeError: no"] * 2 and found["dead"].raws == [None, None]
    assert found["late"].runs == [4, 4] and found["late"].errors == [None, None]
    # each call was made once: one for an answer, three without
    assert {k: len(open(f"{log}/{k}-0").read()) for k in found} == {"good": 1, "empty": 3, "prose": 3, "dead": 3, "late": 3}


def stub(row):
    return json.dumps({"score": scoring.stub_grade(row["cot"], row["target_idx"])})


def test_convincingness_refuses_unknown_options(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 7, "b"), (3, None, "c")], "id int, target_idx int, cot string")
    rows = rows.withColumn("question", F.lit("q")).withColumn("choices", F.array(F.lit("x")))
    found = {r.id: r for r in judging.convincingness(rows, ["id"], stub).collect()}
    assert found[1].target == "A" and found[1].mean == scoring.stub_grade("a", 0)
    assert (found[2].target, found[2].runs, found[2].errors) == (None, [], ["invalid target_idx=7"])
    assert found[3].errors == ["invalid target_idx=None"]


def samples(spark, n=6):
    rows = [(f"s{i}", "q", ["x", "y", "z"] if i else [], i % 3, f"cot{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, question string, choices array<string>, answer int, cot string")


def test_precompute_resumes_and_keeps_good_results_only(spark, tmp_path):
    root, flag = str(tmp_path / "w"), tmp_path / "broken"
    flag.write_text("1")
    path = str(flag)

    def regenerate(row):
        import os

        if row["id"] == "s2" and os.path.exists(path):
            raise RuntimeError("down")
        return {"cf_cot": "" if row["id"] == "s3" and os.path.exists(path) else f"cf {row['id']} {row['target_idx']}", "regen_model": "m"}

    run = lambda judge=stub: {r.id: r.counterfactual for r in precompute.precompute(spark, root, samples(spark), regenerate, judge, k=2).collect()}
    first = run()
    assert first["s0"].error == "empty_choices" and first["s0"].counterfactuals == []
    assert [c.error for c in first["s2"].counterfactuals] == ["RuntimeError: down"] * 2
    assert [c.error for c in first["s3"].counterfactuals] == ["empty_cot"] * 2
    one = first["s1"]
    assert one.orig_score == scoring.stub_grade("cot1", 1) and one.orig_target_letter == "B"
    assert sorted(c.target_letter for c in one.counterfactuals) == ["A", "C"]
    assert all(c.cf_score == scoring.stub_grade(c.cf_cot, c.target_idx) for c in one.counterfactuals)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/good").collect()) == ["s1", "s4", "s5"]
    flag.unlink()

    def never(row):
        raise AssertionError("kept results are not judged again")

    again = {r.id: r.counterfactual for r in precompute.precompute(spark, root, samples(spark).where("id <> 's2' AND id <> 's3'"), never, never, k=2).collect()}
    assert again["s1"] == one
    assert all(c.error is None for k in ("s2", "s3") for c in run()[k].counterfactuals)
    texts = precompute.precompute(spark, str(tmp_path / "texts"), samples(spark), regenerate, k=1).collect()
    assert {r.counterfactual.orig_score for r in texts} == {None} and sum(len(r.counterfactual.counterfactuals) for r in texts) == 5


def test_existing_counterfactuals_are_judged(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "q", ["x", "y"], 0, "cot", "cf", "B"), ("b", "q", ["x"], 1, "", "cf", "C"), ("c", "q", ["x"], 1, "cot", "cf", None), ("d", "q", ["x"], 1, "fail", "cf", "A")],
        "id string, question string, choices array<string>, answer int, cot string, cf_cot string, wrong_letter string",
    )

    def judge(row):
        return "?" if row["cot"] == "fail" else stub(row)

    found = {r.id: r.counterfactual for r in precompute.judge_existing(spark, str(tmp_path / "w"), rows, judge).collect()}
    assert found["a"].orig_score == scoring.stub_grade("cot", 0) and found["a"].counterfactuals[0].cf_score == scoring.stub_grade("cf", 1)
    assert found["b"].orig_score is None and found["b"].error is None and found["b"].counterfactuals[0].error is None
    assert found["c"].counterfactuals[0].error == "missing_wrong_letter"
    assert found["d"].error == "original not scored"
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "w/good")).collect()) == ["a", "b"]


def test_failures_on_end_stop_a_run(spark):
    fails = {3, 4, 10, 11, 12, 13, 20}
    rows = spark.range(30).withColumnRenamed("id", "at")
    call = lambda own: own.withColumn("bad", F.col("at").isin(*fails))
    for limit, last in ((2, 4), (3, 12), (4, 13), (5, 29)):
        for batch in (1, 4, 7, 100):
            done, stopped = judging.scored_until(rows, call, F.col("bad"), "at", limit, batch)
            assert sorted(r["at"] for r in done.collect()) == list(range(last + 1)) and stopped == (limit < 5)
    empty, stopped = judging.scored_until(rows.limit(0), call, F.col("bad"), "at")
    assert empty.collect() == [] and not stopped


def test_two_judges_and_reuse(spark):
    rows = spark.createDataFrame(
        [("a", "q", ["x", "y"], 0, "cot", [(1, "cf1"), (2, "")]), ("b", "q", ["x"], 0, "cot", [(1, "")]), ("c", "q", ["x"], 1, "dead", [(0, "dead")])],
        "id string, question string, choices array<string>, answer int, cot string, cfs array<struct<target_idx: int, cf_cot: string>>",
    )

    def cand(row):
        if row["cot"] == "dead":
            raise RuntimeError("no")
        return '{"score": 3}'

    done, stopped = judging.compared(rows, stub, cand, tries=1)
    found = {(r.id, r.k): r for r in done.collect()}
    assert sorted(found) == [("a", -1), ("a", 0), ("c", -1), ("c", 0)] and not stopped
    assert (found["a", 0].ref_score, found["a", 0].cand_score) == (scoring.stub_grade("cf1", 1), 3.0)
    assert found["c", 0].dead and found["c", 0].cand_score is None and not found["a", 0].dead
    reuse = spark.createDataFrame([("a", -1, 5.0), ("a", 0, 1.0)], "id string, k int, cand_score double")
    again = {(r.id, r.k): r.cand_score for r in judging.compared(rows, stub, cand, reuse, tries=1)[0].collect()}
    assert again["a", 0] == 1.0 and again["a", -1] == 5.0
    assert {r.cand_score for r in judging.compared(rows, stub, cand, ref_only=True, tries=1)[0].collect()} == {None}
    assert judging.compared(rows, stub, cand, tries=1, limit=1)[1]


def test_quality_is_asked_where_it_is_missing(spark):
    hub = spark.createDataFrame(
        [("a", True, None), ("b", True, 2.0), ("c", False, None), ("d", True, None)], "id string, c1 boolean, s double"
    ).select("id", F.struct(F.col("c1").alias("C1")).alias("filters"), F.struct(F.col("s").alias("c2_score")).alias("signals"),
             F.lit("q").alias("question"), F.array(F.lit("x")).alias("choices"), F.col("id").alias("think"))

    def call(row):
        return '{"justification": 3, "coherence": 4, "clarity": 4}' if row["id"] == "a" else "none"

    out = judging.with_quality(hub, judging.quality(hub, call, tries=1))
    scores = {r.id: r.signals.c2_score for r in out.collect()}
    assert scores == {"a": pytest.approx(11 / 3), "b": 2.0, "c": None, "d": None}


def test_evaluation_goes_on_and_is_rescored_with_one_backup(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    items = spark.createDataFrame([("s", i, "AB"[i % 2], f"p{i}") for i in range(4)], "subset string, sample_idx long, gold string, prompt string")

    def generate(row):
        if row["sample_idx"] == 3:
            raise RuntimeError("down")
        return {"output": f"정답: {'A' if row['sample_idx'] < 2 else 'x'}" + "z" * 90}

    rows = evaluation.evaluate(spark, path, items, generate)
    assert {r.sample_idx: r.predicted for r in rows.collect()} == {0: "A", 1: "A", 2: None}

    def late(row):
        assert row["sample_idx"] == 3
        return {"output": "정답: B"}

    rows = evaluation.evaluate(spark, path, items, late)
    total = {r.subset: r for r in evaluation.summary(rows).collect()}
    assert (total["ALL"].n, total["ALL"].right, total["ALL"].unparsed, total["s"].acc) == (4, 2, 1, 0.5)
    other = str(tmp_path / "old.jsonl")
    records.write_records(rows.withColumn("predicted", F.lit("E")), other)
    assert evaluation.rescore(spark, other)["changed"] == 4
    first = {r.predicted for r in records.read_lines(spark, other + ".bak_strict", evaluation.RESULT).collect()}
    assert first == {"E"} and evaluation.rescore(spark, other)["changed"] == 0
    assert {r.predicted for r in records.read_lines(spark, other + ".bak_strict", evaluation.RESULT).collect()} == {"E"}


def test_side_files(spark, tmp_path):
    path = str(tmp_path / "deep" / "x.txt")
    write_text(spark, path, "é\n1")
    write_text(spark, path, "é\n2")
    assert read_text(spark, path) == "é\n2" and exists(spark, path)
    assert records.first_existing(spark, None, str(tmp_path / "no"), path) == path
    assert records.first_existing(spark, str(tmp_path / "no")) is None
    records.register_dataset(spark, str(tmp_path / "r.json"), "a", {"x": 1})
    assert records.register_dataset(spark, str(tmp_path / "r.json"), "b", {}) == {"a": {"x": 1}, "b": {}}


def test_command_line(spark, tmp_path):
    n, text = 12, " ".join(["word"] * 25)
    at = lambda name: str(tmp_path / name)
    bank = [{"subset": "nurse", "sample_idx": i, "question": "q", "choices": ["x", "y"], "gold": i % 2} for i in range(n)]
    traces = [{"subset": "nurse", "sample_idx": i, "reasoning_content": text, "reasoning": "", "predicted": "AB"[i % 2 if i else 1]} for i in range(n)]
    cf = [
        {"id": f"nurse_{i:04d}", "cot": "<think>a</think>", "metadata": {"counterfactual": {"orig_score": 5.0, "counterfactuals": [{"cf_cot": "<think>but</think>", "cf_score": 1.0 + i % 5}]}}}
        for i in range(n)
    ]
    for name, rows in (("bank.jsonl", bank), ("traces.jsonl", traces), ("cf.jsonl", cf)):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    main(["unified", "--input", at("traces.jsonl"), "--bank", at("bank.jsonl"), "--output", at("hub")])
    main(["merge-c3", "--unified", at("hub"), "--cf", at("cf.jsonl"), "--hedge", "off", "--output", at("c3")])
    rows = {r.id: r.filters for r in spark.read.json(at("c3")).collect()}
    assert not rows["nurse_0000"].C3 and rows["nurse_0001"].C3 and not rows["nurse_0004"].C3  # wrong answer, wide and narrow gap
    main(["make-crand", "--unified", at("c3"), "--output", at("crand")])
    assert sum(r.filters.C_rand for r in spark.read.json(at("crand")).collect()) == sum(f.C3 for f in rows.values())
    main(["export", "--input", at("crand"), "--arm", "C-rand", "--output", at("sft"), "--registry", at("registry.json")])
    assert spark.read.json(at("sft")).count() == sum(f.C3 for f in rows.values())
    assert json.loads((tmp_path / "registry.json").read_text())["C-rand"]["file_name"] == at("sft")
    results = [
        {"arm": a, "seed": 1, "subset": "s", "sample_idx": i, "predicted": "A", "is_correct": (i + k) % 3 == 0, "output_chars": 10, "pos": 0}
        for k, a in enumerate(("C1", "C3")) for i in range(9)
    ]
    (tmp_path / "res.jsonl").write_text("".join(json.dumps(r) + "\n" for r in results))
    main(["statistics", "--input", at("res.jsonl"), "--output", at("stats.json"), "--pairs", "C3:C1", "C2:C1", "--draws", "50"])
    found = json.loads((tmp_path / "stats.json").read_text())
    assert found["all"]["pairs"][0]["only_a"] == 3 and len(found["clean"]["pairs"]) == 1


def test_commands_of_calibration_judges_and_samples(spark, tmp_path):
    n, at = 24, lambda name: str(tmp_path / name)
    text = " ".join(["word"] * 25)
    write = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("bank.jsonl", [{"subset": "nurse", "sample_idx": i, "question": "q", "choices": ["x", "y"], "gold": i % 2} for i in range(n)])
    write("traces.jsonl", [{"subset": "nurse", "sample_idx": i, "reasoning_content": f"{text} {'more ' * i}", "reasoning": "", "predicted": "AB"[i % 2]} for i in range(n)])
    write("cf.jsonl", [
        {"id": f"nurse_{i:04d}", "cot": "<think>a</think>", "metadata": {"counterfactual": {"orig_score": 5.0, "counterfactuals": [{"cf_cot": "<think>but</think>", "cf_score": 1.0 + i % 5}]}}}
        for i in range(n)
    ])
    main(["unified", "--input", at("traces.jsonl"), "--bank", at("bank.jsonl"), "--output", at("hub")])
    main(["merge-c3", "--unified", at("hub"), "--cf", at("cf.jsonl"), "--hedge", "off", "--output", at("c3")])
    c3 = {r.id for r in spark.read.json(at("c3")).collect() if r.filters.C3}

    main(["calibrate", "--cf", at("cf.jsonl"), "--unified", at("c3"), "--output", at("cal.json"), "--gaps", "1", "2"])
    found = json.loads((tmp_path / "cal.json").read_text())
    assert found["distribution"]["n"] == n and len(found["sweep"]) == 4 and found["auto"]["cut"] in found["auto"]["candidates"]
    kept = {(r["gap"], r["min_orig"]): r["kept"] for r in found["sweep"]}
    assert kept[1.0, None] == sum(4 - i % 5 >= 1 for i in range(n)) and kept[2.0, 2.0] == sum(4 - i % 5 >= 2 for i in range(n))

    write("cuts.jsonl", [{"cut": c, "accuracy": acc + s / 100, "pos": int(10 * c)} for c, acc in ((1.0, 0.5), (1.5, 0.8)) for s in (0, 1)])
    main(["verify-cuts", "--input", at("cuts.jsonl"), "--chosen", "1.0", "--output", at("cuts.json")])
    assert json.loads((tmp_path / "cuts.json").read_text())["verdict"] == "revisit"

    samples = [{"id": f"s{i}", "question": "q", "choices": ["x", "y"], "answer": 0, "cot": f"c{i}", "cfs": [{"target_idx": 1, "cf_cot": f"f{i}"}]} for i in range(9)]
    write("train.jsonl", samples)
    main(["compare", "--input", at("train.jsonl"), "--ref", "stub", "--cand", "stub", "--output", at("same")])
    found = json.loads((tmp_path / "same.summary.json").read_text())
    assert found["label_agreement"] == found["kappa"] == found["reject_agreement"] == 1.0 and found["swap"] and found["texts"] == 18
    main(["compare", "--input", at("train.jsonl"), "--ref", "stub", "--cand", "stub", "--cand-model", "other", "--output", at("differ")])
    assert json.loads((tmp_path / "differ.summary.json").read_text())["label_agreement"] < 1

    make = ["precompute", "--root", at("kept"), "--scorer", "stub", "--judge", "stub", "--no-reasoning"]
    main([*make, "--input", at("train.jsonl"), "--output", at("made")])
    (row,) = spark.read.json(at("made")).where("id = 's0'").collect()
    assert row.counterfactual.counterfactuals[0].cf_cot == "option 1 of q" and row.counterfactual.orig_score is not None
    write("test.jsonl", samples)
    for more in (["--input", at("test.jsonl")], ["--input", at("train.jsonl"), "--split", "test"]):
        with pytest.raises(ValueError):
            main([*make, *more, "--output", at("refused")])
    with pytest.raises(ValueError):
        scorer("absent")
    assert scorer("tracemill.operators.models:_stub", role="judge")({"cot": "x"}) == scorer("stub")({"cot": "x"})

    main(["quality", "--unified", at("c3"), "--root", at("q"), "--judge", "stub", "--output", at("scored")])
    scores = {r.id: r.signals.c2_score for r in spark.read.json(at("scored")).collect()}
    main(["quality", "--unified", at("c3"), "--root", at("q"), "--judge", "stub", "--model", "other", "--output", at("again")])
    assert {r.id: r.signals.c2_score for r in spark.read.json(at("again")).collect()} == scores  # nothing is asked again
    assert spark.read.parquet(at("q") + "/quality").count() == n

    main(["length-matched", "--unified", at("c3"), "--arm", "C3", "--bins", "3", "--output", at("matched")])
    assert spark.read.json(at("matched")).count() == len(c3) == json.loads((tmp_path / "matched.summary.json").read_text())["n"]
    main(["low-data", "--unified", at("c3"), "--arm", "C3", "--n", "5", "--output", at("few")])
    assert spark.read.json(at("few")).count() == 5
    write("res.jsonl", [
        {"arm": a, "seed": 1, "subset": "s", "sample_idx": i, "predicted": "A", "is_correct": (i + k) % 3 == 0, "output_chars": 10, "pos": 0}
        for k, a in enumerate(("C1", "C3")) for i in range(9)
    ])
    main(["report", "--unified", at("c3"), "--input", at("res.jsonl"), "--output", at("report.md"), "--pairs", "C3:C1"])
    said = (tmp_path / "report.md").read_text()
    assert "| C1 | 1 | 0.3333" in said and "## Pairs" in said and f"| {n} |" in said
