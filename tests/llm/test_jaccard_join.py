import random

import numpy as np
from helpers import docs, oracle, same
from pyspark.sql import functions as F

from tracemill.llm import jaccard_join as J


def sets(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(data, percent=75):
    s = {i: sets(t) for i, t in data}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b]:
                k = len(s[a] & s[b])
                if 100 * k >= percent * (len(s[a]) + len(s[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((i, len(s[i]), find(i)) for i in s)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(seed, groups=12, each=10):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    data = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.choice([6, 20, 80, 300]))]
        for _ in range(each):
            w = edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06, 0.1]))
            w += passage if rng.random() < 0.3 else []
            data.append((len(data), " ".join(w[: int(len(w) * rng.choice([1, 1, 0.8]))])))
    return data + [(len(data), None), (len(data) + 1, ""), (len(data) + 2, "A b"), (len(data) + 3, "a  B"), (len(data) + 4, "A b c")]


def check(spark, data, **options):
    rows = J.document_components(docs(spark, *data, extra=True), **options).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(data)


def test_oracle(spark, sf_small):
    same(J.op10_jaccard_join(spark, sf_small).toPandas(), oracle(J.ORACLE, sf_small))


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_bands_and_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "_blocks", lambda rows, most: F.ceil(rows / 3).cast("int"))
    monkeypatch.setattr(J, "PIVOTS", 1)
    check(spark, corpus(2, groups=6, each=14))
    check(spark, corpus(3, groups=3, each=30))


def test_many_buckets_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET_SHINGLES", 100)
    monkeypatch.setattr(J, "MOST_PARTITIONS", 3)
    check(spark, corpus(4))


def test_oracle_with_bands_and_blocks_forced(spark, sf_small, monkeypatch):
    monkeypatch.setattr(J, "_blocks", lambda rows, most: F.ceil(rows / 2).cast("int"))
    same(J.op10_jaccard_join(spark, sf_small).toPandas(), oracle(J.ORACLE, sf_small))


def test_large_clusters_take_few_tiles(spark):
    n = [J.TILE_ROWS * 3, 40]
    rows = [(1, i, 46) for i in range(n[0])] + [(2, 10**6 + i, 46 + i % 2 * 20) for i in range(n[1])]
    banded = J._banded(spark.createDataFrame(rows, "key long, node long, n long")).cache()
    first = J._first_tiles(banded).count()
    assert first <= n[0] + 3 * J.PIVOTS + 2 * n[1]
    near = spark.createDataFrame([(i, 0) for i in range(1, n[0] - 5)], "node long, root long")
    second = J._second_tiles(banded, near)
    assert second.count() <= n[0] + 5 * 4  # five rows outside, in one block, meet all of three blocks
    assert J._second_tiles(banded.where("key = 2"), near) is None


def test_bands_and_tiles_take_few_shuffles(spark):
    """The driver keeps each task of each shuffle: on skewed input, bands by joins filled its memory."""
    rows = spark.createDataFrame([(i % 9, i, 40 + i % 60) for i in range(300)], "key long, node long, n long")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    banded = J._banded(rows)
    assert shuffles(banded) <= 4
    roots = spark.createDataFrame([(i, i % 9) for i in range(9, 200)], "node long, root long")
    written = []
    banded = banded.withColumn("wide", F.lit(True)).localCheckpoint()
    tiles = J._second_tiles(banded, roots, lambda df: written.append(shuffles(df)) or df.localCheckpoint())
    assert shuffles(tiles) <= 4 and len(written) == 1 and written[0] <= 8


def test_bands_beside_are_those_next_to_a_band(spark):
    rows = [(1, 3, 5), (1, 4, 6), (1, 6, 7), (2, 5, 8), (3, 2, None), (3, 3, 9)]
    found = J._beside(spark.createDataFrame(rows, "key long, band int, c int"), "c").collect()
    value = {(k, b): c for k, b, c in rows}
    want = {(k, b, c, value.get((k, b - 1)), value.get((k, b + 1))) for k, b, c in rows}
    assert {(r.key, r.band, r.c, r.c_below, r.c_above) for r in found} == want and len(found) == len(rows)


def test_signatures_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.9])], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)]))
        if not len(b):
            continue
        k = len(np.intersect1d(a, b))
        linked = 100 * k >= 75 * (len(a) + len(b) - k)
        n, maps = [len(a), len(b)], [J.signature(x).tobytes() for x in (a, b)]
        if linked:
            assert J.tile_links([1, 2], n, maps, exact=False)
        assert bool(J.tile_links([1, 2], n, [a.tobytes(), b.tobytes()], exact=True)) == linked


def test_components_close_long_chains(spark):
    from tracemill.llm.shared import Workspace

    rng = random.Random(6)
    name = rng.sample(range(10**6), 201)  # a chain whose ids say nothing of places
    chain = spark.createDataFrame([(name[i], name[i + 1]) for i in range(200)] + [(2 * 10**6, 2 * 10**6 + 1)], "a long, b long")
    for piece in (10**6, 40, 7):
        roots = {r.node: r.root for r in J.components(chain, Workspace(spark, "test"), f"chain-{piece}", piece=piece).collect()}
        low = min(name)
        assert roots == {**{i: low for i in name if i != low}, 2 * 10**6 + 1: 2 * 10**6}


def test_forest_of_random_links():
    rng = np.random.default_rng(8)
    for n in (2, 10, 300):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        found = dict(zip(*(x.tolist() for x in J.forest(u, v))))
        root = {int(i): int(i) for i in np.concatenate([u, v])}
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist()):
                root[a] = root[b] = min(root[a], root[b])
        assert {i: found.get(i, i) for i in root} == root


def test_a_hot_shingle_is_not_gathered(spark):
    """Near copies in thousands: their common shingles' members come straight from the prefixes."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(edited(rng, base, 0.01))) for i in range(300)] + [(900 + i, f"other {i} text of its own kind") for i in range(20)]
    check(spark, data)


def test_clashing_columns_stay(spark):
    table = docs(spark, (1, "a b c d e f"), (2, "a b c d e f"), (3, "x")).withColumn("__TM_GONE", F.lit("mine"))
    found = J.keep_one(table).collect()
    assert sorted(r.doc_id for r in found) == [1, 3] and {r["__TM_GONE"] for r in found} == {"mine"}
