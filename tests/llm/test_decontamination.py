import random
import re

from helpers import docs, oracle, same

from tracemill.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(data, items, size=13):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = []
    for doc, text in data:
        w = words(text)
        hit, found = set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_oracle(spark, sf_small):
    same(D.op3_decontamination(spark, sf_small).toPandas(), oracle(D.ORACLE, sf_small))


def test_slices_and_short_items_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["aa", "Bé", "c-3", "dd."]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 5, 13, 14, 30]))) for i in range(12)] + [(99, None)]
    items = [x for x in items if len(words(x[1])) not in (1,)]
    data = [(i, text(rng.randint(0, 200)) + " " + (rng.choice(items)[1] or "")) for i in range(40)] + [(40, None), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slice_windows in (10**6, 15):
        rows = D.contamination(docs(spark, *data, extra=True), bench, slice_windows=slice_windows).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows) == brute(data, items)


def test_removal_of_documents_and_spans(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = " ".join(f"x{i}" for i in range(400))
    data = [(1, clean), (2, clean + " " + item), (3, f"{item}, end"), (4, None), (5, " ".join(item.split()[:12]))]
    assert sorted(r.doc_id for r in D.decontaminate(docs(spark, *data), bench).collect()) == [1, 2, 4, 5]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs(spark, *data, extra=True), bench, spans_only=True).collect()}
    assert cut[3] == ", end" and cut[2] == clean + " " and cut[4] is None


def test_very_long_texts_and_shared_windows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([("b", item), ("a", item + " more"), ("b", item), ("c", "tiny item"), ("d", None), ("e", "")], "item_id string, text string")
    long = "x " * 300_000 + item + " " + "y" * 100_000 + " tiny item"
    (row,) = D.contamination(docs(spark, (1, long), extra=True), bench).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (300_023, 22, 3, False)
    import hashlib

    assert row.items_sha256 == hashlib.sha256(b"a,b,c").hexdigest()


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(docs(spark, (1, "a b"), (1, "a b"), (None, None)), none).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in rows) == [("1", 2, 0), ("1", 2, 0), ("None", 0, 0)]
    assert D.contamination(docs(spark, (1, "a")).limit(0), none).collect() == []
