"""What the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import ship_package
from tracemill.sources.records import read_table
from tracemill.workspace import Workspace, setting

__all__ = ["Workspace", "arrow_map", "batch_of", "columns", "fold", "map_batches", "setting", "table", "unused"]

table = read_table


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give memory that a finished task freed back to the system: a Python worker outlives many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` by executors that have this package."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        tidy()

    return df.mapInArrow(run, schema)


def arrow_map(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str
) -> DataFrame:
    """``map_batches`` for functions of a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return map_batches(df, run, schema)


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A small table's columns on the driver, through Arrow: no object is made for a row."""
    found = df.toArrow()
    return {n: found.column(n).to_numpy(zero_copy_only=False) for n in found.column_names}


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
