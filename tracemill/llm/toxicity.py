"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashes of its runs of 2 to 6 characters, each with the levels that their
number reaches: once, twice, four times, and twice or more in every 500 characters.  ASCII and Latin-1
letters are lower-cased, white space is one kind of character, and texts begin and end with it.
Labelled texts give each feature a log-count ratio (the log of its share of toxic texts over its
share of others).  The features with the most significant ratios stay; a logistic regression is
trained on their ratios, and its bias is put right for the shares of the two classes.  Labels, ids
and other columns never enter a score.

The training texts are a bounded sample: ``max_rows`` labelled rows at most, half of them of each
label, taken in the order of a hash of their ids.  Features are counted and ranked on the executors;
one task fits the regression, in blocks, from the numbers of the features that the sample's texts
have; only the chosen features and their weights reach the driver, never texts or counts.  Scoring
looks each n-gram up in a fixed table and streams over whole texts.  A text longer than a chunk is
cut, with an overlap, and its counts are added up, so memory does not follow a text's length.

Nulls: null texts are empty, null labels are left out, a null id is in the fold of the empty text.
Repeated labels of an id: the highest counts.  Of repeated rows of a labelled id the smallest text
trains, so the sample stays bounded.  Ties: of
equally significant features those with the lower number stay; of ids with equal hashes the lower id.
Without rows of both labels every score is the smoothed share of toxic rows.  Columns are selected by
name and renamed, so extra ones may have any name.  Empty tables give an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import ship_package

from . import textkit as tk
from .shared import Workspace, arrow_map, batch_of, columns, fold, map_batches, table

ORDERS = (2, 3, 4, 5, 6)
BITS, LEVELS, DENSE = 20, 4, 500
#: A chunk's bytes, and code points of a long text that are hashed at a time.
CHUNK, SLICE = 1 << 18, 1 << 18
FEATURES = LEVELS << BITS
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0xC0:0xD7] += 0x20
_FOLD[0xD8:0xDF] += 0x20
_FOLD[0x09:0x0E] = 0x20


@dataclass
class Model:
    """``weight`` by feature, zero for those that are not in use."""

    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.used = (self.weight != 0).reshape(LEVELS, -1).any(0)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for first, rows, doc, feature in features(column, self.used):
            out[first : first + rows] += np.bincount(doc, self.weight[feature], rows)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _points(data: bytes) -> np.ndarray:
    """Code points, folded, as unsigned 64-bit numbers."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(tk.U)
    small = points < 256
    points[small] = _FOLD[points[small]]
    return points


def _runs(text: np.ndarray, used: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By order: the places of runs and their buckets, of ``used`` buckets only if given."""
    value = text
    for order in range(2, ORDERS[-1] + 1):
        if len(value) < 2:
            return
        value = value[:-1] * tk.U(0x100000001B3) + text[order - 1 :]
        if order in ORDERS:
            bucket = ((value + tk.U(order)) * tk.U(0x9E3779B97F4A7C15) >> tk.U(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(used[bucket]) if used is not None else np.arange(len(bucket))
            yield order, at, bucket[at]


def _levels(times: np.ndarray, length: np.ndarray | int) -> list[np.ndarray]:
    dense = (times >= 2) & (times * DENSE >= 2 * np.maximum(length, 1))
    return [times >= 1, times >= 2, times >= 4, dense]


def _long(chunk: tk.Chunk, used: np.ndarray | None) -> np.ndarray:
    """Features of one long text: its slices overlap by the longest run less one, and a run counts once."""
    times = np.zeros(1 << BITS, np.int64)
    lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    cuts = [*lead[::SLICE].tolist(), len(chunk.data)]
    carry = np.zeros(0, tk.U)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = [carry, _points(chunk.data[a:b].tobytes())]
        if not i:
            own[0] = np.full(1, tk.U(0x20))
        if i == len(cuts) - 2:
            own.append(np.full(1, tk.U(0x20)))
        text = np.concatenate(own)
        for order, at, bucket in _runs(text, used):
            new = bucket[at >= len(carry) - order + 1]
            value, count = np.unique(new, return_counts=True)
            times[value] += count
        carry = text[1 - ORDERS[-1] :]
    bucket = np.flatnonzero(times)
    return np.concatenate([bucket[x] + (k << BITS) for k, x in enumerate(_levels(times[bucket], len(lead)))])


def features(
    column: pa.Array, used: np.ndarray | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk: first row, rows, and the (row, feature) pairs, of ``used`` buckets only if given."""
    for chunk in tk.chunks(column, CHUNK):
        if chunk.rows == 1 and len(chunk.data) > 4 * SLICE:
            feature = _long(chunk, used)
            yield chunk.first, 1, np.zeros(len(feature), np.int64), feature
            continue
        points = _points(chunk.data.tobytes())
        lead = (chunk.data & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(lead)])[chunk.offsets]  # code points before each row
        start = count + np.arange(chunk.rows + 1)  # a space before each text, and one at the end
        text = np.full(len(points) + chunk.rows + 1, tk.U(0x20))
        text[np.arange(len(points)) + np.repeat(np.arange(1, chunk.rows + 1), np.diff(count))] = points
        pairs = [np.zeros(0, np.int64)]
        for order, at, bucket in _runs(text, used):
            row = np.searchsorted(start, at, "right") - 1
            inside = at + order - 1 <= start[np.minimum(row + 1, chunk.rows)]  # may end on the next text's space
            pairs.append((row[inside] << BITS) | bucket[inside])
        both, times = np.unique(np.concatenate(pairs), return_counts=True)
        row, bucket = both >> BITS, both & ((1 << BITS) - 1)
        levels = _levels(times, np.diff(count)[row])
        row = np.concatenate([row[x] for x in levels])
        feature = np.concatenate([bucket[x] + (k << BITS) for k, x in enumerate(levels)])
        order = np.argsort(row, kind="stable")
        yield chunk.first, chunk.rows, row[order], feature[order]


def training_rows(labels: DataFrame, toxic: str, id_col: str, trains: Column, max_rows: int) -> tuple[DataFrame, dict]:
    """A bounded sample of labelled ids with labels, half of each label at most, and the labels' counts."""
    known = labels.where(F.col(toxic).isNotNull() & trains)
    known = known.groupBy(F.col(id_col).alias("__tm_id")).agg((F.max(toxic) > 0).cast("int").alias("__tm_toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("__tm_toxic").count().collect()}
    each = [
        known.where(F.col("__tm_toxic") == y).orderBy(F.xxhash64("__tm_id"), "__tm_id").limit(max_rows // 2) for y in (0, 1)
    ]
    return each[0].unionByName(each[1]), counts


_NONE = 65_535
_COUNT = pa.schema([("bucket", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
_ROW = pa.schema([("y", pa.int32()), ("features", pa.binary())])
_WEIGHT = pa.schema([("place", pa.int32()), ("weight", pa.float64())])


def _counted(texts: DataFrame) -> DataFrame:
    """(bucket, toxic, other): how many texts of each label have a feature; bucket -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, FEATURES), np.uint16)  # a sample has fewer rows than that holds
        rows = np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1))
            rows += np.bincount(y, minlength=2)
            for first, n, doc, feature in features(batch.column(0)):
                own = y[first : first + n][doc]
                for k in (0, 1):
                    value, times = np.unique(feature[own == k], return_counts=True)
                    found[k, value] += times.astype(np.uint16)
        for a in range(0, FEATURES, 1 << 18):
            part = found[:, a : a + (1 << 18)]
            at = np.flatnonzero(part.any(0))
            yield batch_of(_COUNT, a + at, part[1, at].astype(np.int64), part[0, at].astype(np.int64))
        yield batch_of(_COUNT, [-1], [int(rows[1])], [int(rows[0])])

    counts = map_batches(texts, count, "bucket long, toxic long, other long")
    return counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(
    docs: DataFrame, labels: DataFrame, trains: Column, toxic: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", max_rows: int = 12_000, n_features: int = 10_000, least: int = 3, rounds: int = 150,
    l2: float = 2.0,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which ``trains``, a column of ids, is true.

    A feature needs ``least`` texts; the ``n_features`` (under 65 535, as ``max_rows`` must be) with the most significant ratios stay.
    """
    spark = docs.sparkSession
    ship_package(spark)
    space = Workspace(spark, "toxicity")
    sample, known = training_rows(labels, toxic, id_col, trains, max_rows)
    narrow = docs.select(F.col(id_col).alias("__tm_id"), F.col(text_col).cast("string").alias("__tm_text"))
    # at most max_rows rows of two numbers: small enough for every executor
    texts = narrow.join(F.broadcast(sample), "__tm_id").groupBy("__tm_id").agg(
        F.min("__tm_text").alias("__tm_text"), F.max("__tm_toxic").alias("__tm_toxic")
    )
    texts = space.save(texts.select("__tm_text", "__tm_toxic"), "sample")
    counts = space.save(_counted(texts), "counts")  # FEATURES rows at most
    whole = counts.where("bucket = -1").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q")).first()
    n1, n0 = whole["p"] or 0, whole["q"] or 0
    p, q = F.col("toxic").cast("double") + 1, F.col("other").cast("double") + 1
    ratio = F.log(p / F.lit(float(n1 + 2))) - F.log(q / F.lit(float(n0 + 2)))
    ranked = counts.where((F.col("bucket") >= 0) & (F.col("toxic") + F.col("other") >= least))
    ranked = ranked.select("bucket", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("rank"))
    best = columns(ranked.orderBy(F.col("rank").desc(), "bucket").limit(n_features).select("bucket", "ratio"))
    order = np.argsort(best["bucket"])
    bucket, ratio = best["bucket"][order], best["ratio"][order]
    if not n1 or not n0 or not len(bucket):
        space.drop("sample", "counts")
        share = (known.get(1, 0) + 0.5) / (known.get(1, 0) + known.get(0, 0) + 2)
        return Model(np.zeros(FEATURES, np.float32), float(np.log(share / (1 - share))))
    held = spark.sparkContext.broadcast((bucket, ratio))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(FEATURES, _NONE, np.uint16)
        place[held.value[0]] = np.arange(len(held.value[0]))
        used = (place != _NONE).reshape(LEVELS, -1).any(0)
        for batch in batches:
            for first, n, doc, at in features(batch.column(0), used):
                own = place[at]
                doc, own = doc[own != _NONE], own[own != _NONE]
                cuts = np.searchsorted(doc, np.arange(1, n))
                yield batch_of(_ROW, batch.column(1).slice(first, n), [x.tobytes() for x in np.split(own, cuts)])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, each = [], []
        for batch in batches:
            y.append(np.asarray(batch.column(0)))
            each += [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)]
        size = np.array([len(x) for x in each])
        flat = np.concatenate(each)
        each.clear()
        weight, bias = _fit(flat, size, np.concatenate(y).astype(np.float64), held.value[1], rounds, l2)
        yield batch_of(_WEIGHT, np.arange(-1, len(weight)), np.append(bias, weight))

    # one task fits a sample of bounded size; its rows come in an order of their own, whoever sends them first
    design = map_batches(texts, rows_of, "y int, features binary").repartition(1).sortWithinPartitions("y", "features")
    fitted_ = columns(map_batches(design, fit, "place int, weight double"))
    order = np.argsort(fitted_["place"])
    bias, weight = fitted_["weight"][order][0], fitted_["weight"][order][1:]
    # the sample holds the classes in other shares than the labelled rows
    bias += np.log(max(known.get(1, 0), 1) / max(known.get(0, 0), 1)) - np.log(n1 / n0)
    table_ = np.zeros(FEATURES, np.float32)
    table_[bucket] = weight * ratio
    held.unpersist()
    space.drop("sample", "counts")
    return Model(table_, float(bias))


#: Feature numbers that a step of the fit holds at once.
_BLOCK = 1 << 20


def _fit(
    flat: np.ndarray, size: np.ndarray, y: np.ndarray, ratio: np.ndarray, rounds: int, l2: float
) -> tuple[np.ndarray, float]:
    """Logistic regression on the ratios of present features, by full-batch Adam steps in blocks of rows.

    ``flat`` has the feature numbers of all rows in turn, ``size`` how many are each row's.
    """
    n, ends = len(y), np.concatenate([[0], np.cumsum(size)])
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + _BLOCK, "right")) - 1))
    blocks = list(zip(cuts, cuts[1:], strict=False))
    square = sum(float((ratio * ratio)[flat[ends[a] : ends[b]]].sum()) for a, b in blocks) / n
    scale = float(np.sqrt(max(square, 1e-9)))
    ratio = ratio / scale
    w, bias = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        own = w * ratio
        g, total = np.zeros(len(w)), 0.0
        for a, b in blocks:
            part, many = flat[ends[a] : ends[b]], size[a:b]
            some = np.flatnonzero(many)
            z = np.full(b - a, bias)
            if len(some):
                z[some] += np.add.reduceat(own[part], ends[a:b][some] - ends[a])
            e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[a:b]) / n
            g += np.bincount(part, np.repeat(e, many), len(w))
            total += e.sum()
        g = np.append(g * ratio + l2 * w / n / 100, total)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w / scale, bias


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = held.value.scores(batch.column(2))
        return batch_of(_SCORED, batch.column(0), batch.column(1), found, (found >= 0.5).astype(np.int32))

    narrow = docs.select(F.col(id_col).cast("long"), held_out.alias("held_out"), F.col(text_col).cast("string"))
    return arrow_map(narrow, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without those that score ``limit`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.scores(batch.column(at)) < limit, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the query and of the pipeline: fold 0 of five is never learnt from."""
    return train(docs, labels, fold(F.col("doc_id"), 5) != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, table(spark, sf_dir, "labels")), fold(F.col("doc_id"), 5) == 0)
