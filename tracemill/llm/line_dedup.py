"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches.  A batch is reduced to one row per line key: its 128-bit hash, the
number of documents holding it and the largest of their ids.  The batch is merge-anti-joined with
the runs on disk: keys that no run holds become a run of their own, and what the batch says of known
keys becomes a run of updates.  So every key stands in one run only, with the numbers of the batch
that brought it, and its updates are added when the totals are read.  When a level holds two runs
they are merged into one run of the next level, so a row is rewritten a logarithmic number of times
and a batch meets few runs.  Runs are bucketed and sorted by hash; a batch is dealt to the same
buckets once, and merging it with the runs, merging runs and reading totals shuffles and sorts no run.
(Runs are merged by joins: Spark 4.1 takes a union of bucketed tables for one that is still dealt by
their keys, and what aggregates or joins it then goes wrong.)

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  Keys shorter than
``min_chars`` code points are never counted or dropped.  A key found in ``min_docs`` documents or
more keeps its lines only in the document with the largest id.

Nulls: a null text is one empty line; null ids count as one document, smaller than all others.
Repeated rows of one id are one document and are cleaned alike; a key twice in the document that
keeps it stays twice.  Ties: of equal largest ids all rows are the one document that keeps the line.  Very long texts and lines are read whole, one at a time.  Columns added on the
way take names that the input does not have.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, arrow_map, batch_of, setting, table, unused

KEY = ["__tm_h1", "__tm_h2"]
_LINES = pa.schema([("__tm_doc", pa.int64()), ("__tm_h1", pa.int64()), ("__tm_h2", pa.int64())])


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # on bytes both are limited to ASCII


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars


def line_hashes(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and distinct line key of at least ``min_chars`` code points."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, digests = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = {
                xxhash.xxh3_128_digest(key)
                for line in (text.as_py() or "").encode().split(b"\n")
                if _counts(key := line_key(line), min_chars)
            }
            ids += [doc] * len(found)
            digests += found
        pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield batch_of(_LINES, ids, pairs[:, 0], pairs[:, 1])

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return arrow_map(narrow, run, "__tm_doc long, __tm_h1 long, __tm_h2 long").dropDuplicates()


#: Keys of a bucket, about; buckets at least, and at most (Spark takes 100 000): beyond, buckets hold more keys and spill.
BUCKET_KEYS, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 12, 50_000


class LineRuns:
    """Levelled runs of (hash, documents, largest id): of new keys, each in one run only, and of updates."""

    def __init__(self, space: Workspace, buckets: int = LEAST_BUCKETS):
        self.space, self.buckets = space, buckets
        self.keys: list[tuple[str, DataFrame] | None] = []  # by level
        self.updates: list[tuple[str, DataFrame] | None] = []
        self.written: list[str] = []

    def _in_order(self) -> object:
        return setting(self.space.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _write(self, df: DataFrame, kind: str) -> tuple[str, DataFrame]:
        name = f"{kind}-{len(self.written)}"
        self.written.append(name)
        return name, self.space.save_sorted(df.select(*KEY, "docs", "last"), name, KEY, self.buckets)

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose keys no run holds: merge-anti-joined with one run after another."""
        for _, run in filter(None, self.keys):
            batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def ingest(self, lines: DataFrame) -> None:
        """Add a batch of (document, key) rows."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("__tm_doc").alias("last"))
        with self._in_order():
            name, own = self._write(own.repartition(self.buckets, *KEY), "batch")
            fresh = self._write(self.unknown(own), "keys")
            known = self._write(own.join(fresh[1].select(*KEY).hint("merge"), KEY, "left_anti"), "updates")
            self.space.drop_sorted(name)
            self._add(self.keys, fresh, "keys")
            self._add(self.updates, known, "updates")

    def _add(self, levels: list[tuple[str, DataFrame] | None], run: tuple[str, DataFrame], kind: str) -> None:
        for level, held in enumerate(levels):
            if held is None:
                levels[level] = run
                return
            levels[level] = None
            both = self._write(self.merged(held[1], run[1], kind == "updates"), kind)
            self.space.drop_sorted(held[0], run[0])
            run = both
        levels.append(run)

    @staticmethod
    def merged(one: DataFrame, other: DataFrame, add: bool) -> DataFrame:
        """Two runs in one: documents of updates are added; a key that is new is new in one of them only."""
        other = other.select(*KEY, F.col("docs").alias("more"), F.col("last").alias("later"))
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0)) if add else F.coalesce("docs", "more")
        out = one.join(other.hint("merge"), KEY, "full_outer")
        return out.select(*KEY, docs.alias("docs"), F.greatest("last", "later").alias("last"))

    def totals(self) -> list[DataFrame]:
        """By run of keys, each key's documents and largest id: where it is new, and what updates say."""
        out = []
        for _, run in filter(None, self.keys):
            for _, update in filter(None, self.updates):
                update = update.select(*KEY, F.col("docs").alias("more"), F.col("last").alias("later"))
                run = run.join(update.hint("merge"), KEY, "left").select(
                    *KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last")
                )
            out.append(run)
        return out

    def hot(self, min_docs: int, name: str) -> DataFrame:
        """Keys of ``min_docs`` documents or more with the largest id, written."""
        with self._in_order():
            found = [run.where(F.col("docs") >= min_docs).select(*KEY, "last") for run in self.totals()]
            out = self.space.save(reduce(DataFrame.unionByName, found), name)
        return out

    def drop(self) -> None:
        """Delete all runs, also those that a failed batch left behind: bucketed tables stand in the catalog."""
        self.space.drop_sorted(*self.written)
        self.keys.clear()
        self.updates.clear()


def dropped_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document that loses lines: ``__tm_doc`` and ``__tm_drop``, the keys' hashes as 16 bytes each."""
    space = Workspace(docs.sparkSession, "line-dedup")
    lines = line_hashes(docs, min_chars, id_col, text_col)
    part = F.pmod(F.xxhash64("__tm_doc"), F.lit(batches)).cast("int")
    lines = space.save(lines.withColumn("__tm_batch", part), "lines", ["__tm_batch"])
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-lines.count() // BUCKET_KEYS)))
    runs = LineRuns(space, buckets)
    try:
        for batch in range(batches):
            runs.ingest(lines.where(F.col("__tm_batch") == batch))
        hot = runs.hot(min_docs, "hot")
    finally:
        runs.drop()
    lost = lines.join(hot.hint("merge"), KEY).where(~F.col("__tm_doc").eqNullSafe(F.col("last")))
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    lost = lost.groupBy("__tm_doc").agg(F.collect_list(F.concat(*map(word, KEY))).alias("__tm_drop"))
    lost = space.save(lost, "lost")
    space.drop("lines", "hot")
    return lost


def _kept(text: str | None, drop: list[bytes] | None, min_chars: int) -> tuple[int, int, bytes]:
    raw = (text or "").encode()
    if not drop:
        return raw.count(b"\n") + 1, 0, raw
    gone = set(drop)
    lines = raw.split(b"\n")
    kept = []
    for line in lines:
        key = line_key(line)
        if not (_counts(key, min_chars) and _digest(key) in gone):
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _digest(key: bytes) -> bytes:
    return np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").astype(">i8").tobytes()


def _joined(docs: DataFrame, lost: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the keys to drop, and the name of that column."""
    of, drop = unused(docs, "__tm_doc"), unused(docs, "__tm_drop")
    lost = lost.select(F.col("__tm_doc").alias(of), F.col("__tm_drop").alias(drop))
    # the table of drops grows with the documents: the same join at every size, and none that broadcasts it
    same = docs[id_col].cast("long").eqNullSafe(lost[of])
    return docs.join(lost.hint("merge"), same, "left").drop(of), drop


def dedup_lines(
    docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4,
    id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
) -> DataFrame:
    """``docs`` with the lines dropped from the text; ``length_col``, where present, is counted anew."""
    lost = dropped_lines(docs, min_docs, min_chars, batches, id_col, text_col)
    wide, drop = _joined(docs, lost, id_col)
    schema = wide.drop(drop).schema
    at = wide.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        drops = batch.column(drop).to_pylist()
        texts = batch.column(at)
        out = [
            t.as_py() if not d else _kept(t.as_py(), d, min_chars)[2].decode() for t, d in zip(texts, drops, strict=True)
        ]
        columns = list(batch.columns)[:-1]
        columns[at] = pa.array(out, texts.type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = arrow_map(wide, run, schema)
    return out.withColumn(length_col, F.length(text_col).cast("long")) if length_col in docs.columns else out


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]
)


def line_report(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4) -> DataFrame:
    """Per document: lines before dropping, lines dropped, and the SHA-256 of what is kept."""
    lost = dropped_lines(docs, min_docs, min_chars, batches)
    wide, _ = _joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lost, "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            _kept(t.as_py(), d.as_py(), min_chars) for t, d in zip(batch.column(1), batch.column(2), strict=True)
        ]
        digests = [hashlib.sha256(x).hexdigest() for *_, x in rows]
        return batch_of(_RESULT, batch.column(0), [x[0] for x in rows], [x[1] for x in rows], digests)

    return arrow_map(wide, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
