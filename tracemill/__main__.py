"""``python -m tracemill``: the stages from traces to exports, and the statistics, from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.config import GapGate, RuleGates, load, number_or_none
from tracemill.operators import arms, calibration, counterfactual, stats
from tracemill.operators.models import scorer
from tracemill.plans import drivers, evaluation, pipeline
from tracemill.plans.precompute import precompute
from tracemill.sources import records
from tracemill.workspace import write_text

HUB = schemas.UNIFIED + ", has_think boolean"
BANK = "subset string, sample_idx long, question string, choices array<string>, gold int"
RESULTS = "arm string, seed int, subset string, sample_idx long, gold string, predicted string, is_correct boolean, output_chars int, pos long"


def _hub(spark: SparkSession, path: str) -> DataFrame:
    return records.read_records(spark, path, HUB)


def unified(spark: SparkSession, a: argparse.Namespace) -> None:
    traces = records.read_records(spark, a.input, schemas.RAW_TRACE).drop("question")
    hub = arms.unified(traces, records.read_records(spark, a.bank, BANK), load(RuleGates, a.config, spark=spark))
    records.write_records(hub, a.output)


def merge_c3(spark: SparkSession, a: argparse.Namespace) -> None:
    limits = load(GapGate, a.config, missing_ok=a.config is None, spark=spark)
    given = {"gap": a.gap, "hedge": a.hedge, "min_orig": a.min_orig}
    # a threshold that was given counts, also if it was turned off
    limits = GapGate(**{**limits.__dict__, **{k: number_or_none(v) for k, v in given.items() if v is not None}})
    rows = records.read_records(spark, a.cf, schemas.SCORED_SAMPLE)
    cf = rows.select("id", "cot", F.col("metadata.counterfactual").alias("c"))
    cots = F.transform("c.counterfactuals", lambda x: x["cf_cot"])
    hedge = counterfactual.hedge_signals(F.col("cot"), cots)["hedge_gap"]
    scores = F.transform("c.counterfactuals", lambda x: x["cf_score"])
    gate = counterfactual.counterfactual_gate(F.col("c.orig_score"), scores, hedge, limits)
    decided = cf.select("id", gate.passed.alias("passed"), gate.score.alias("gap"), F.col("c.orig_score").alias("orig_score"))
    records.write_records(arms.merge_c3(_hub(spark, a.unified), decided), a.output)


def merge_c2(spark: SparkSession, a: argparse.Namespace) -> None:
    records.write_records(arms.merge_c2(_hub(spark, a.unified)), a.output)


def make_crand(spark: SparkSession, a: argparse.Namespace) -> None:
    records.write_records(arms.make_crand(_hub(spark, a.unified), a.seed), a.output)


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    records.write_records(arms.export_chat(_hub(spark, a.input), a.arm.replace("-", "_"), a.instruction), a.output)
    if a.registry:
        records.register_dataset(spark, a.registry, a.name or a.arm, {"file_name": a.output, "formatting": "messages"})


def rescore(spark: SparkSession, a: argparse.Namespace) -> None:
    print(evaluation.rescore(spark, a.input))


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_records(spark, a.input, RESULTS)
    pairs = stats.known_pairs(rows, [tuple(p.split(":")) for p in a.pairs])
    tables = stats.twin(rows, pairs, a.draws) if pairs else {}
    write_text(spark, a.output, "{" + ",\n".join(f'"{kind}": {stats.as_json(found)}' for kind, found in tables.items()) + "}")


def everything(spark: SparkSession, a: argparse.Namespace) -> None:
    traces = records.read_records(spark, a.input, schemas.RAW_TRACE).drop("question")
    bank = records.read_records(spark, a.bank, BANK)
    cf = records.read_records(spark, a.cf, schemas.SCORED_SAMPLE).select("id", F.col("cot").alias("orig_cot"), "metadata.counterfactual.*")
    cf = cf.select(
        "id", "orig_score", "orig_cot", F.transform("counterfactuals", lambda x: x["cf_score"]).alias("cf_scores"),
        F.transform("counterfactuals", lambda x: x["cf_cot"]).alias("cf_cots"),
    )
    quality = records.read_records(spark, a.quality, "id string, c2_score double")
    rules, limits = load(RuleGates, a.config, spark=spark), load(GapGate, a.config, spark=spark)
    out = pipeline.run(spark, a.output, traces, bank, cf, quality, rules, limits, a.seed)
    for arm in schemas.ARMS:
        records.write_records(out[arm], f"{a.output.rstrip('/')}/export-{arm}", mode="overwrite")


SAMPLES = "id string, question string, choices array<string>, answer int, cot string, cfs array<struct<target_idx: int, cf_cot: string>>"


def _numbers(given: list[str]) -> list[float | None]:
    return [number_or_none(x) for x in given]


def calibrate(spark: SparkSession, a: argparse.Namespace) -> None:
    hub = _hub(spark, a.unified) if a.unified else None
    rows = drivers.signals(records.read_records(spark, a.cf, schemas.SCORED_SAMPLE), hub)
    found = drivers.calibrate(rows, _numbers(a.gaps), _numbers(a.hedges), _numbers(a.min_origs))
    write_text(spark, a.output, drivers.as_text(found))
    print(found["auto"]["text"] if found["auto"] else "no gaps")


def verify_cuts(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = records.read_records(spark, a.input, "cut double, accuracy double, pos long")
    found = calibration.verify_cuts(rows, number_or_none(a.chosen)).first().asDict()
    write_text(spark, a.output, drivers.as_text(found))
    print(f"{found['verdict']}: best cut {found['best_cut']}")


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    judge = lambda spec, model: scorer(spec, role="judge", model=model, reasoning=a.reasoning)
    rows, found = drivers.compare_judges(records.read_records(spark, a.input, SAMPLES), judge(a.ref, a.ref_model), judge(a.cand, a.cand_model), a.reps)
    records.write_records(rows, a.output)
    write_text(spark, f"{a.output.rstrip('/')}.summary.json", drivers.as_text(found))
    print(f"swap: {found['swap']}, borderline: {found['borderline']}")


def make_counterfactuals(spark: SparkSession, a: argparse.Namespace) -> None:
    """Refused for a test split, whether it is named or the file's name says so."""
    split = spark.range(1).select(records.split_of(F.lit(a.input)).alias("s")).first().s
    for name in (a.split, split):
        records.refuse_test_split(name or "")
    samples = records.read_records(spark, a.input, "id string, question string, choices array<string>, answer int, cot string")
    judge = scorer(a.judge, role="judge", reasoning=a.reasoning) if a.judge else None
    found = precompute(spark, a.root, samples, scorer(a.scorer, role="write", model=a.model, reasoning=a.reasoning), judge, a.k, a.seed, a.reps)
    records.write_records(found, a.output)


def quality(spark: SparkSession, a: argparse.Namespace) -> None:
    judge = scorer(a.judge, role="judge", model=a.model, reasoning=a.reasoning)
    records.write_records(drivers.score_quality(spark, a.root, _hub(spark, a.unified), judge, a.reps), a.output)


def _export(spark: SparkSession, a: argparse.Namespace, hub: DataFrame, ids: DataFrame, arm: str) -> None:
    rows, summary = drivers.selected(hub, ids, arm, a.instruction)
    records.write_records(rows, a.output)
    write_text(spark, f"{a.output.rstrip('/')}.summary.json", drivers.as_text(summary.first().asDict()))


def length_matched(spark: SparkSession, a: argparse.Namespace) -> None:
    hub, arm = _hub(spark, a.unified), a.arm.replace("-", "_")
    _export(spark, a, hub, arms.length_matched(hub, arm, a.bins, a.seed), arm)


def low_data(spark: SparkSession, a: argparse.Namespace) -> None:
    hub, arm = _hub(spark, a.unified), a.arm.replace("-", "_")
    _export(spark, a, hub, arms.low_data(hub, arm, a.n, a.seed, not a.plain), arm)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = stats.last_results(records.read_records(spark, a.input, RESULTS))
    pairs = stats.known_pairs(rows, [tuple(p.split(":")) for p in a.pairs])
    accuracy, compared = stats.seed_accuracy(rows), stats.mcnemar(stats.mcnemar_table(stats.per_item(rows), pairs))
    pipeline.report(arms.arm_matrix(_hub(spark, a.unified)), accuracy, compared, a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run: object, *options: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name)
        for option in options:
            own.add_argument(f"--{option}", required=True)
        own.set_defaults(run=run)
        return own

    add("unified", unified, "input", "bank", "output").add_argument("--config")
    c3 = add("merge-c3", merge_c3, "unified", "cf", "output")
    for option in ("config", "gap", "hedge", "min-orig"):
        c3.add_argument(f"--{option}")
    add("merge-c2", merge_c2, "unified", "output")
    add("make-crand", make_crand, "unified", "output").add_argument("--seed", type=int, default=42)
    e = add("export", export, "input", "arm", "output")
    e.add_argument("--instruction", default="Solve the question.")
    e.add_argument("--registry")
    e.add_argument("--name")
    add("rescore", rescore, "input")
    s = add("statistics", statistics, "input", "output")
    s.add_argument("--pairs", nargs="+", required=True, help="pairs of arms, as C3:C1")
    s.add_argument("--draws", type=int, default=10_000)
    c = add("calibrate", calibrate, "cf", "output")
    c.add_argument("--unified", help="a hub, to keep to the rows of C1")
    c.add_argument("--gaps", nargs="+", default=["0.5", "1", "1.5", "2"])
    c.add_argument("--hedges", nargs="+", default=["off"])
    c.add_argument("--min-origs", nargs="+", default=["off", "2"])
    v = add("verify-cuts", verify_cuts, "input", "output")
    v.add_argument("--chosen", help="the cut in use")
    judges = add("compare", compare, "input", "ref", "cand", "output")
    judges.add_argument("--ref-model")
    judges.add_argument("--cand-model")
    m = add("precompute", make_counterfactuals, "input", "root", "scorer", "output")
    m.add_argument("--judge", help="a scorer; without one texts are made and not scored")
    m.add_argument("--split")
    m.add_argument("--k", type=int, default=1)
    m.add_argument("--seed", type=int, default=42)
    q = add("quality", quality, "unified", "root", "judge", "output")
    for own in (judges, m, q):
        own.add_argument("--reps", type=int, default=1)
        own.add_argument("--reasoning", action=argparse.BooleanOptionalAction)
    for own in (m, q):
        own.add_argument("--model")
    same, few = add("length-matched", length_matched, "unified", "arm", "output"), add("low-data", low_data, "unified", "arm", "output")
    same.add_argument("--bins", type=int, default=20)
    few.add_argument("--n", type=int, required=True)
    few.add_argument("--plain", action="store_true", help="not stratified by subject")
    for own in (same, few):
        own.add_argument("--seed", type=int, default=42)
        own.add_argument("--instruction", default="Solve the question.")
    t = add("report", report, "unified", "input", "output")
    t.add_argument("--pairs", nargs="+", default=[])
    r = add("run", everything, "input", "bank", "cf", "quality", "output")
    r.add_argument("--config")
    r.add_argument("--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
