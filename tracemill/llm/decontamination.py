"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased.  An item's
windows are its runs of ``size`` consecutive words; an item of fewer words, but not none, is one
window.  The hashes of a bounded number of windows are broadcast and document windows are looked up
in them; every hit is verified against the item's words.  A benchmark with more windows than
``slice_windows`` is scanned in slices of whole items, each broadcast by itself, and the hits of a
document are put together, so memory stays bounded and nothing is left out.  A slice holds the items'
words once, back to back, and some 40 bytes a window; a worker holds one slice at a time.

A word inside any occurrence of a window is hit.  A document is contaminated if ``n_hit > 0`` and
``ratio * n_hit >= n_words``.

Nulls: a null text has no words; a null item id is the text ``null``.  Repeated rows: each document
row gets its own result, repeated benchmark rows count as one item by their id.  Ties: items are named
in the order of their ids.  Very long texts are whole, at some 60 bytes of memory a byte.  Columns are
selected by name and renamed, so extra ones may have any name.  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import arrow_map, batch_of, table

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class WindowSet:
    """Windows of some items: by length, sorted hashes, where the words stand and which items have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        texts = [b" ".join(words) for _, words in items]
        self.data = b"".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        words = tk.words(tk.Chunk(0, len(texts), np.frombuffer(self.data, np.uint8), offsets), tk.SPACE)
        length = np.minimum(words.count(), size)
        item = np.array([number[n] for n, _ in items], np.int64)
        self.n = 0
        #: by length: hash, first and last byte, the bounds of its items, the items, and a mask of hashes
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted(set(length[length > 0].tolist())):
            value, at = words.window(k)
            row = np.searchsorted(words.rows, at, "right") - 1
            own = length[row] == k
            value, at, row = value[own], at[own], row[own]
            order = np.lexsort((item[row], value))
            value, at, row = value[order], at[order], row[order]
            start, end, owner = words.start[at], words.end[at + k - 1], item[row]
            new = np.concatenate([[True], value[1:] != value[:-1]])
            # windows of one hash are one window if their words are the same, which they all but always are
            for i in np.flatnonzero(~new).tolist():
                if self.data[start[i] : end[i]] != self.data[start[i - 1] : end[i - 1]]:
                    new[i] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(value))
            mask = np.zeros(1 << _BITS, bool)
            mask[value >> tk.U(64 - _BITS)] = True
            self.by_length[k] = (value[first], start[first], end[first], first, last, owner, mask)
            self.n += len(first)

    def __len__(self) -> int:
        return self.n

    def scan(self, words: tk.Words) -> Iterator[tuple[int, int, list[str]]]:
        """Verified hits: (first word, number of words, items)."""
        for k, (value, start, end, first, last, owner, mask) in self.by_length.items():
            found, at = words.window(k)
            near = np.flatnonzero(mask[found >> tk.U(64 - _BITS)])
            lo = np.searchsorted(value, found[near])
            hi = np.searchsorted(value, found[near], "right")
            for j, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                i = int(at[j])
                own = b" ".join(words.lower[words.start[x] : words.end[x]].tobytes() for x in range(i, i + k))
                for w in range(a, b):
                    if self.data[start[w] : end[w]] == own:
                        yield i, k, [self.names[x] for x in set(owner[first[w] : last[w]].tolist())]


def _slices(benchmark: DataFrame, size: int, slice_windows: int) -> Iterator[WindowSet]:
    """Window sets of whole items, of about ``slice_windows`` windows at most; items stream to the driver."""
    items: list[tuple[str, list[bytes]]] = []
    n = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for name, text in rows.toLocalIterator():
        words = item_words(text)
        items.append(("null" if name is None else name, words))
        n += max(1, len(words) - size + 1)
        if n >= slice_windows:
            yield WindowSet(items, size)
            items, n = [], 0
    if items:
        yield WindowSet(items, size)


class SliceSet:
    """Broadcast window sets.  Of several, a worker holds one at a time."""

    def __init__(self, benchmark: DataFrame, size: int, slice_windows: int):
        sc = benchmark.sparkSession.sparkContext
        self.slices = [sc.broadcast(x) for x in _slices(benchmark, size, slice_windows)]

    def each(self) -> Iterator[WindowSet]:
        for held in self.slices:
            yield held.value
            if len(self.slices) > 1 and hasattr(held, "_value"):
                del held._value  # read again from the executor's block when it is next used

    def hits(self, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """By row: the number of words, spans of hit words, and items found."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
        items: list[set[str]] = [set() for _ in range(len(column))]
        counts: list[int] = [0] * len(column)
        for windows in self.each():
            for chunk in tk.chunks(column):
                words = tk.words(chunk, tk.PUNCT)
                for i, k, found in windows.scan(words):
                    row = int(np.searchsorted(words.rows, i, "right")) - 1
                    a = i - int(words.rows[row])
                    own = spans[chunk.first + row]
                    if own and own[-1][0] <= a <= own[-1][1] <= a + k:
                        own[-1] = (own[-1][0], a + k)
                    else:
                        own.append((a, a + k))
                    items[chunk.first + row].update(found)
                counts[chunk.first : chunk.first + chunk.rows] = words.count().tolist()
        if not self.slices:
            for chunk in tk.chunks(column):
                counts[chunk.first : chunk.first + chunk.rows] = tk.words(chunk, tk.PUNCT).count().tolist()
        return counts, spans, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as disjoint ones, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _verdict(n_words: int, spans: list[tuple[int, int]], ratio: int) -> tuple[int, bool]:
    hit = sum(b - a for a, b in _union(spans))
    return hit, hit > 0 and ratio * hit >= n_words


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
])
_RESULT_SQL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, ratio: int = 20, slice_windows: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document row: words, words hit, items found (count and digest) and the verdict."""
    sets = SliceSet(benchmark, size, slice_windows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, spans, items = sets.hits(batch.column(1))
        verdicts = [_verdict(n, s, ratio) for n, s in zip(counts, spans, strict=True)]
        return batch_of(
            _RESULT, batch.column(0), counts, [h for h, _ in verdicts], [len(x) for x in items],
            [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], [c for _, c in verdicts],
        )

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, _RESULT_SQL)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, ratio: int = 20, slice_windows: int = 1_000_000,
    spans_only: bool = False, text_col: str = "text", length_col: str = "n_chars",
) -> DataFrame:
    """``docs`` without contaminated documents; with ``spans_only``, with all documents and without hit words."""
    sets = SliceSet(benchmark, size, slice_windows)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        counts, spans, _ = sets.hits(column)
        if not spans_only:
            keep = [not _verdict(n, s, ratio)[1] for n, s in zip(counts, spans, strict=True)]
            return batch.filter(pa.array(keep, pa.bool_()))
        out = [_without(t.as_py(), _union(s)) if s else t.as_py() for t, s in zip(column, spans, strict=True)]
        columns = [pa.array(out, column.type) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = arrow_map(docs, run, docs.schema)
    recount = spans_only and length_col in docs.columns
    return out.withColumn(length_col, F.length(text_col).cast("long")) if recount else out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    bounds = [m.span() for m in _WORD.finditer(raw.lower())]
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TOKENS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, dw.k, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
