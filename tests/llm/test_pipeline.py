import corpus_pipeline
import pytest
from helpers import docs, oracle, rows
from test_line_dedup import brute as brute_lines

from tracemill.llm import decontamination, jaccard_join, mixing, toxicity
from tracemill.llm.shared import table
from pyspark.sql import functions as F


def frame(df):
    return df.toPandas().sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    """The documents before each stage and what the last one returns, as pandas frames."""
    kept = table(spark, sf_small, "documents")
    out = [frame(kept)]
    for name, stage in corpus_pipeline.STAGES:
        columns = kept.columns
        kept = stage(spark, kept, sf_small)
        assert kept.columns == columns or name == "mixing"
        out.append(frame(kept))
    return out


def same(found, want):
    assert rows(found) == rows(want[found.columns.tolist()])


def test_names_and_the_whole_run(spark, sf_small, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    same(frame(corpus_pipeline.run(spark, sf_small)), stages[-1])


def test_toxicity_removes_what_scores_a_half(spark, sf_small, stages):
    whole = table(spark, sf_small, "documents")
    scores = toxicity.score(whole, toxicity.fitted(whole, table(spark, sf_small, "labels")), F.lit(False))
    bad = {r.doc_id for r in scores.collect() if r.score >= 0.5}
    assert bad
    same(stages[1], stages[0][~stages[0].doc_id.isin(bad)])


def test_line_dedup_equals_brute_force(stages):
    before, after = stages[1], stages[2]
    want = dict(brute_lines(list(zip(before.doc_id, before.text))))
    assert dict(zip(after.doc_id, after.text)) == want
    assert (after.n_chars == after.text.str.len()).all() and len(after) == len(before)
    same(after.drop(columns=["text", "n_chars"]), before)


def test_jaccard_join_keeps_the_first_of_each_component(sf_small, stages):
    found = oracle(jaccard_join.ORACLE, sf_small, stages[2])
    keep = found[found.doc_id == found.component_id].doc_id
    assert len(keep) < len(found)
    same(stages[3], stages[2][stages[2].doc_id.isin(keep)])


def test_decontamination_equals_the_oracle(sf_small, stages):
    found = oracle(decontamination.ORACLE, sf_small, stages[3])
    assert found.contaminated.any()
    same(stages[4], stages[3][~stages[3].doc_id.isin(found[found.contaminated].doc_id)])


def test_mixing_equals_the_oracle(sf_small, stages):
    want = oracle(mixing.ORACLE, sf_small, stages[4])
    assert len(want)
    same(stages[5], want)


def test_stages_pass_odd_rows(spark, sf_small):
    odd = docs(spark, (None, None), (1, ""), (1, ""), (2, "a\n\nb"), (3, "long " * 60_000), extra=True)
    for name, stage in corpus_pipeline.STAGES:
        assert len(stage(spark, odd, sf_small).collect()) >= (1 if name != "mixing" else 0)
        assert stage(spark, odd.limit(0), sf_small).collect() == []
