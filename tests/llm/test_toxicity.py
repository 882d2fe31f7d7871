import numpy as np
import pyarrow as pa
from helpers import docs
from pyspark.sql import functions as F

from tracemill.llm import toxicity as X


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = X.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 2


def found_in(texts):
    out = [set() for _ in texts]
    for first, _, row, feature in X.features(pa.array(texts)):
        for r, f in zip(row.tolist(), feature.tolist(), strict=True):
            out[first + r].add(divmod(f, 1 << X.BITS))  # level, bucket
    return out


def test_features_are_runs_of_characters_with_levels():
    texts = ["Abc", "", "é\tb", "abcabc abc", "ÀB", "àb"]
    found = found_in(texts)
    runs = lambda t: [t[i : i + k] for k in X.ORDERS for i in range(len(t) - k + 1)]
    for f, t in zip(found, ("abc", "", "é b", "abcabc abc"), strict=False):
        own = runs(f" {t} ")
        assert [sum(level == k for level, _ in f) for k in (0, 1, 2)] == [sum(own.count(r) >= n for r in set(own)) for n in (1, 2, 4)]
    assert found[4] == found[5]
    assert found_in(["xyz"]) == found_in(["q", "xyz"])[1:]  # texts beside it play no part
    assert not {b for level, b in found_in(["ab " * 5 + "x" * 5000])[0] if level == 3} & {b for _, b in found_in(["ab"])[0]}


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abé ñ😀"), 5000))
    whole = found_in([text])[0]
    monkeypatch.setattr(X, "SLICE", 700)
    assert found_in([text])[0] == whole
    assert found_in(["q", text])[1] == whole


def test_chosen_features_and_weights_equal_a_plain_fit(spark):
    """The whole result against brute force: ratios, ranks, regression and scores without Spark."""
    rng = np.random.default_rng(1)
    data = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "bad" if i % 3 == 0 else "good"], 6))) for i in range(60)]
    truth = {i: int(i % 3 == 0) for i, _ in data}
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    table = docs(spark, *data, extra=True)
    found = {r.doc_id: r.score for r in X.score(table, X.train(table, labels, F.lit(True), n_features=50, rounds=40), F.lit(False)).collect()}
    sets = dict(zip([i for i, _ in data], [{f + (k << X.BITS) for k, f in s} for s in found_in([t for _, t in data])]))
    n1, n0 = sum(truth.values()), len(truth) - sum(truth.values())
    rank = []
    for f in set().union(*sets.values()):
        p, q = (sum(f in sets[i] for i in sets if truth[i] == y) for y in (1, 0))
        if p + q >= 3:
            ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
            rank.append((-round(abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1)), 9), f, ratio))
    best = sorted(sorted(rank)[:50], key=lambda x: x[1])
    x = np.array([[r if f in sets[i] else 0 for _, f, r in best] for i in sets])
    y = np.array([truth[i] for i in sets])
    x = x / (scale := np.sqrt((x * x).sum(1).mean()))
    w, b, m, v = np.zeros(50), np.log((n1 + 1) / (n0 + 1)), np.zeros(51), np.zeros(51)
    for t in range(1, 41):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ e + 2.0 * w / len(y) / 100, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / 41) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose([found[i] for i in sets], want, atol=2e-3) and scale > 0


def test_repeated_rows_of_an_id_are_one_text(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    data = [(1, "vile words"), (2, "kind words"), (3, "vile thing"), (4, "kind thing")]
    one = X.train(docs(spark, *data), labels, F.lit(True), least=1)
    many = X.train(docs(spark, *data, *[(1, "vile words"), (1, "zzz")] * 50), labels, F.lit(True), least=1)
    assert (one.weight == many.weight).all() and one.bias == many.bias


def test_ties_and_file_layout_play_no_part(spark):
    data = [(i, "same words here " + ("vile" if i % 2 else "kind")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, toxic int")
    results = []
    for parts in (1, 7):
        table = docs(spark, *data).repartition(parts)
        model = X.train(table, labels, F.lit(True), max_rows=20, n_features=5, rounds=20)
        assert (model.weight != 0).sum() == 5
        results.append(sorted((r.doc_id, r.score) for r in X.score(table, model, F.lit(False)).collect()))
    assert results[0] == results[1]


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    table = docs(spark, (1, "you fool fool"), (2, "fine words"), (3, None), (None, "z " * 100_000), (3, None), extra=True)
    model = X.train(table, labels, F.lit(True))
    rows = X.score(table, model, F.lit(False)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    empty = X.train(table, labels.limit(0), F.lit(True))
    assert {r.predicted for r in X.score(table, empty, F.lit(False)).collect()} == {0}
    assert X.score(table.limit(0), model, F.lit(False)).collect() == []
    assert X.keep_clean(table, empty).columns == table.columns
