"""Table functions for SQL: rows from a value (lateral), and rows from the ordered rows of a key.

``register`` makes them known to a session: ``json_paths(text)`` gives a row for each scalar in a JSON text,
``event_runs(TABLE(...) PARTITION BY ... ORDER BY ...)`` the runs of equal values in a key's order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from tracemill.session import ship_package


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str | None]]:
    """Paths and texts of the scalars in a JSON value, in order; a list's elements are numbered from 0.  Empty ones have none."""
    stack: list[tuple[str, object]] = [(path, value)]
    while stack:
        at, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{at}.{k}" if at else k, v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            stack += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        else:
            yield at, x if isinstance(x, str) else None if x is None else json.dumps(x)


class JsonPaths:
    """A row (path, value) for each scalar; none for null, empty or broken texts.  A text that is one scalar has an empty path."""

    def eval(self, text: str | None) -> Iterator[tuple[str, str | None]]:
        if not text or not text.strip():
            return
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return
        yield from leaves(value)


class EventRuns:
    """Runs of rows with one ``kind`` in the order of a key's rows: their number, kind, length, first and last ``id``.

    The table's columns are key, id and kind.  Rows come in batches; only the run that is open is held between them.
    """

    def __init__(self) -> None:
        self.key = self.kind = self.first = self.last = None
        self.nth = self.n = 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        out = []
        key, ids, kinds = (rows.column(i).to_pylist() for i in range(3))
        for k, i, kind in zip(key, ids, kinds, strict=True):
            if self.n and kind == self.kind:
                self.n += 1
            else:
                if self.n:
                    out.append(self._run())
                self.nth, self.n, self.kind, self.first = self.nth + 1, 1, kind, i
            self.key, self.last = k, i
        if out:
            yield self._table(out)

    def terminate(self) -> Iterator[pa.Table]:
        if self.n:
            yield self._table([self._run()])

    def _run(self) -> tuple:
        return self.key, self.nth, self.kind, self.n, self.first, self.last

    @staticmethod
    def _table(runs: list[tuple]) -> pa.Table:
        names, kinds = RUN_COLUMNS, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*runs, strict=True), kinds, strict=True)})


RUN_COLUMNS = ("key", "nth", "kind", "n", "first_id", "last_id")


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL.  (Spark refuses lateral use of functions from Arrow batches to Arrow tables.)"""
    ship_package(spark)
    spark.udtf.register("json_paths", udtf(JsonPaths, returnType="path string, value string", useArrow=True))
    runs = "key long, nth long, kind string, n long, first_id long, last_id long"
    spark.udtf.register("event_runs", arrow_udtf(EventRuns, returnType=runs))
