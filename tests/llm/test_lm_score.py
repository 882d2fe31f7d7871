import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
from helpers import docs
from pyspark.sql import functions as F

from tracemill.llm import lm_score as M
from tracemill.llm import textkit as tk


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def base(data, train):
    c = Counter(t for i, text in data if train(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    unit = math.log10(n + 0.1 * (v + 1))
    out = {}
    for i, text in data:
        own = tokens(text)
        out[i] = (len(own), sum(c[t] > 0 for t in own), n, sum(math.log10(c[t] + 0.1) - unit for t in own))
    return out


def test_base_is_exact_and_model_is_better(spark, sf_small):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    want = base(data, lambda i: crc32(str(i).encode()) % 10 != 0)
    rows = M.op2_lm_score(spark, sf_small).collect()
    assert len(rows) == len(data)
    for r in rows:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 10 == 0) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def small(spark, n=40):
    data = [(i, " ".join(f"w{(i * j + j) % 17}{'x' * (j % 3)}" for j in range(3 + i % 20))) for i in range(n)] + [(n, None), (n + 1, "new words W1 w1")]
    return data, docs(spark, *data, extra=True)


def known_words_by_hash(spark, table, known):
    train = F.col("doc_id") % 10 != 3
    return M.fit(table, train, rounds=[F.col("doc_id") < 20, F.col("doc_id") >= 20], known=known), train


def test_file_layout_and_known_words_play_no_part(spark):
    _, table = small(spark)
    results = []
    for parts, known in ((1, 10**6), (5, 4), (3, 0)):
        frame = table.repartition(parts)
        model, train = known_words_by_hash(spark, frame, known)
        found = M.score(frame, model, ~train).collect()
        results.append(sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 5) if known > 10 else 0) for r in found))
    assert [[x[:3] for x in r] for r in results[1:]] == [[x[:3] for x in results[0]]] * 2
    frame = table.repartition(7)
    model, train = known_words_by_hash(spark, frame, 10**6)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 5)) for r in M.score(frame, model, ~train).collect()) == results[0]


def word_hash(word):
    return int(tk.hash_words([word.encode()])[0])


MASK = (1 << 64) - 1


def mixed(x):
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * odd & MASK
    return x ^ x >> 31


def plain_log(model, counts, words, i):
    """log10 of token ``i`` of ``words`` (None is the end), one number at a time."""
    vocabulary = model.vocabulary
    start, odd = int(M._START), [int(x) for x in M._ODD]
    before = [word_hash(words[i - k]) if i >= k else start for k in (1, 2, 3)]
    before.append(mixed((before[0] * odd[0] + before[1]) & MASK))
    if words[i] is None:
        item = 0
    else:
        at = np.flatnonzero(vocabulary.hashes == tk.U(word_hash(words[i])))
        item = int(vocabulary.item[at[0]]) if len(at) else -1
        if item < 0:
            raw = words[i].encode()
            item = M.OWN + int(M.ending(tk.words(tk.Chunk(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), tk.SPACE))[0])
    leaf, out = int(vocabulary.leaf[item]), 0.0
    for level in range(2 if item < M.SECOND else 3 if item < M.SECOND + M.THIRD else M.LEVELS):
        node = sum(M.WAYS**k for k in range(level)) + leaf // M.WAYS ** (M.LEVELS - level)
        rows = [((c * o & MASK ^ node * 0x9E3779B97F4A7C15 & MASK) * 0xD6E8FEB86659FD93 & MASK) >> 64 - M.ROW_BITS for c, o in zip(before, odd)]
        z = model.weights[[*rows, (1 << M.ROW_BITS) + node]].astype(float).sum(0)
        z = np.exp(z - z.max())
        out += math.log10(z[leaf // M.WAYS ** (M.LEVELS - 1 - level) % M.WAYS] / z.sum())
    if item >= M.OWN:
        c = counts[words[i]]
        out += (math.log10(c - 0.5) if c else model.tail_unknown[item - M.OWN]) - model.tail_unit[item - M.OWN]
    return out


def test_score_equals_a_plain_version(spark):
    """Whole scores, word by word; frequent words, shared leaves and joined words all take part."""
    data, table = small(spark)
    model, train = known_words_by_hash(spark, table, 10)
    assert 0 < (model.vocabulary.item >= 0).sum() < len(model.vocabulary.hashes) == 10
    counts = Counter(t for i, text in data if i % 10 != 3 for t in tokens(text))
    rows = {r.doc_id: r for r in M.score(table, model, ~train).collect()}
    for i, text in data:
        words = tokens(text)
        want = sum(plain_log(model, counts, words, k) for k in range(len(words)))
        assert math.isclose(rows[i].score, want, rel_tol=1e-4), (i, text)


def test_probabilities_of_all_words_sum_to_one(spark):
    data, table = small(spark)
    model = M.fit(table, F.lit(True))
    counts = Counter(t for _, text in data for t in tokens(text))
    for before in ([], ["w1"], ["w1", "nowhere", "w3x"]):
        words = [*before, None]
        total = 0.0
        for w in counts:
            total += 10 ** plain_log(model, counts, [*before, w], len(before))
        # every shared leaf keeps one outcome for all unknown words
        leaf = model.vocabulary.leaf[M.OWN :].astype(np.int64)
        found = M.sequences(tk.words(chunk_of(" ".join(before)), tk.SPACE), model.vocabulary)
        context = np.repeat(found.context[:, -1:], len(leaf), 1)
        deep = np.full(len(leaf), M.LEVELS)
        total += float((np.exp(M.log_leaf(model.weights, context, leaf, deep)) * 10 ** (model.tail_unknown - model.tail_unit)).sum())
        # leaves of items that no word has
        empty = np.setdiff1d(np.arange(1, M.OWN), model.vocabulary.item)
        context, leaf = np.repeat(found.context[:, -1:], len(empty), 1), model.vocabulary.leaf[empty].astype(np.int64)
        total += float(np.exp(M.log_leaf(model.weights, context, leaf, M.depth_of(empty))).sum())
        assert math.isclose(total, 1, rel_tol=1e-4), words


def chunk_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return tk.Chunk(0, 1, raw, np.array([0, len(raw)]))


def test_steps_learn_what_follows(spark):
    table = docs(spark, *[(i, "the cat sat on the mat and the dog ran") for i in range(200)])
    model = M.fit(table, F.lit(True))
    row = M.score(table.limit(1), model, F.lit(False)).first()
    assert row.score > row.base_score + 1


def test_found_words(spark):
    rng = np.random.default_rng(2)
    value = rng.integers(0, 1 << 63, 5000).astype(tk.U) * tk.U(2)
    value[:50] = value[50] & ~tk.U(0xFFFF) | np.arange(50, dtype=tk.U)  # neighbours in one stretch
    held = np.unique(value)[::2]
    vocabulary = M.Vocabulary(held, np.ones(len(held), np.int64))
    want = {int(h): i for i, h in enumerate(held)}
    assert vocabulary.find(value).tolist() == [want.get(int(v), -1) for v in value]
    assert M.Vocabulary(held[:0], held[:0].astype(np.int64)).find(value).max() == -1


def test_leaves_hold_like_words():
    near = np.zeros((64, 4))
    near[::2, 0], near[1::2, 3] = 9, 9
    place = M.bisected(near, np.ones(64, int), least=8)
    assert sorted(place.tolist()) == list(range(64)) and len({i % 2 for i in np.flatnonzero(place < 32).tolist()}) == 1


def test_leaves_of_all_sizes_fill_the_tree():
    rng = np.random.default_rng(4)
    size = np.array([256] * 3 + [16] * 30 + [1] * (1024 - 3 * 256 - 30 * 16 + 1024))
    size = np.append(size, np.ones(2048 - size.sum(), int))
    place = M.bisected(rng.random((len(size), 5)), size)
    assert (place % size == 0).all()
    taken = np.concatenate([np.arange(p, p + n) for p, n in zip(place, size)])
    assert sorted(taken.tolist()) == list(range(2048))


def test_edges(spark):
    table = docs(spark, (1, None), (None, "A a"), (1, None), (2, "b " * 50_000), (3, "x" * 70_000))
    rows = M.score(table, M.fit(table, F.lit(True)), F.lit(False)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 3, 50_001]
    untrained = M.score(table, M.fit(table, F.lit(False)), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in untrained)
    assert M.score(table.limit(0), M.fit(table, F.lit(True)), F.lit(True)).collect() == []


def test_endings():
    words = tk.words(tk.Chunk(0, 1, np.frombuffer(b"xing ing g ng", np.uint8), np.array([0, 13])), tk.SPACE)
    e = M.ending(words)
    assert e[0] == e[1] and len(set(e[1:].tolist())) == 3


def test_runs_sum_the_errors_of_each_row():
    """Each row once, with all its tokens' errors: rows of one token, of few, of many, and one of all of them."""
    rng = np.random.default_rng(6)
    n = 5000
    rows = np.stack([rng.permutation(n) + 1000, rng.integers(0, 900, n), rng.integers(0, 40, n) + 900, np.full(n, M.ROWS - 1), rng.integers(0, 900, n)])
    error = rng.random((n, M.WAYS), dtype=np.float32)
    want = np.zeros((M.ROWS, M.WAYS))
    for r in rows:
        np.add.at(want, r, error)
    runs = M.Runs(rows)
    assert (runs.row == np.unique(rows)).all() and (runs.row[runs.number] == rows).all()
    assert (runs.size == np.bincount(rows.ravel())[runs.row]).all()
    found = error.take(runs.token[runs.first], 0)
    more, total = runs.sums(error)
    found[more] = total
    assert np.allclose(found, want[runs.row], rtol=1e-4) and sorted(more.tolist()) == np.flatnonzero(runs.size > 1).tolist()


def test_a_step_takes_what_a_plain_one_takes():
    rng = np.random.default_rng(7)
    vocabulary = M.Vocabulary(np.zeros(0, tk.U), np.zeros(0, np.int64))
    vocabulary.leaf = (np.arange(M.ITEMS) % M.LEAVES).astype(np.int32)
    trainer = M.Trainer(rng.normal(size=(M.ROWS, M.WAYS)).astype(np.float32), vocabulary, 0.35)
    context = rng.integers(0, 60, (M.CONTEXTS, 700)).astype(tk.U) * M._ODD[:, None]
    item = rng.integers(0, M.ITEMS, 700) // rng.integers(1, 2000, 700)
    leaf, depth = vocabulary.leaf[item].astype(np.int64), M.depth_of(item)
    now, squares, used = trainer.now.astype(float), np.ones(M.ROWS), np.zeros(M.ROWS)
    for level in range(M.LEVELS):
        _, rows, choice = M._level(context, leaf, depth, level)
        z = np.exp(now[rows].sum(0))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(choice)), choice] -= 1
        gradient = np.zeros((M.ROWS, M.WAYS))
        for r in rows:
            np.add.at(gradient, r, z)
            np.add.at(used, r, 1)
        squares += (gradient**2).sum(1) / M.WAYS
        now -= 0.35 * gradient / np.sqrt(squares)[:, None]
    trainer._step(context, item)
    changes, counted = trainer.changes()
    assert np.allclose(trainer.now, now, atol=1e-4) and (counted == used).all()
    assert np.allclose(changes, now - trainer.first, atol=1e-4)


def test_counts_of_many_words_and_their_endings(spark):
    """Words whose hashes share first bits or not are counted whole, each with its ending."""
    table = docs(spark, *[(i, " ".join(f"w{(i * 37 + j) % 5000}" for j in range(3000))) for i in range(8)])
    want = Counter(t for i in range(8) for t in (f"w{(i * 37 + j) % 5000}" for j in range(3000)))
    found = {r.hash: (r["count"], r.ending) for r in M.token_counts(table.select("text")).collect()}
    assert found.pop(-1) == (8, -1) and len(found) == len(want)
    for word, n in want.items():
        words = tk.words(chunk_of(word), tk.SPACE)
        assert found[int(words.hash.view(np.int64)[0])] == (n, int(M.ending(words)[0]))


def test_a_step_updates_rows_in_stretches(monkeypatch):
    """Same weights whatever the stretch, and no array of all rows' gradients beside that of their weights."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n = M.STEP_TOKENS
    context, item = rng.integers(0, 2**63, (M.CONTEXTS, n)).astype(np.uint64), rng.integers(0, M.ITEMS, n)
    context[:, : n // 2] = context[:, :1]  # long runs and single rows
    words = M.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    words.leaf = rng.integers(0, M.LEAVES, M.ITEMS).astype(np.int32)
    found, peaks = [], []
    for stretch in (n * 8, 2048, 77):
        monkeypatch.setattr(M, "_STRETCH", stretch)
        trainer = M.Trainer(np.zeros((M.ROWS, M.WAYS), np.float32), words, 0.35)
        tracemalloc.start()
        trainer._step(context, item)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        found.append(trainer.changes())
    for values, used in found[1:]:
        assert (values == found[0][0]).all() and (used == found[0][1]).all()
    assert peaks[1] < 0.9 * peaks[0]
