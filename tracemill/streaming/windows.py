"""Event-time streams: sliding windows, sessions and first sightings, with watermarks.

Results are appended once the watermark has passed them.  The watermark of a micro-batch is the latest
time of all batches before it, less the delay; a row is late if, by the watermark of the batch before its
own, its window or session is over.  State is kept in RocksDB, off the heap.  Batches without data are
switched off, so what is emitted depends on the batches alone, not on when a query stops and starts
again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.session import ship_package
from tracemill.workspace import Workspace, setting

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sliding(stream: DataFrame, time: str, delay: str, size: str, slide: str, by: list[str], **measures: Column) -> DataFrame:
    """Measures by window (``started``, ``ended``) and key, of windows that the watermark has passed."""
    window = F.window(time, size, slide).alias("_w")
    out = stream.withWatermark(time, delay).groupBy(window, *by).agg(*(c.alias(n) for n, c in measures.items()))
    return out.select(F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), *by, *measures)


def session_stream(stream: DataFrame, time: str, delay: str, gap: str, by: list[str], **measures: Column) -> DataFrame:
    """Measures by session, which rows no more than a gap apart make up, and key; a late row may join two sessions."""
    window = F.session_window(time, gap).alias("_w")
    out = stream.withWatermark(time, delay).groupBy(window, *by).agg(*(c.alias(n) for n, c in measures.items()))
    return out.select(F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), *by, *measures)


class _FirstSeen(StatefulProcessor):
    """A key's earliest row of the batch that first brings it; forgotten when the watermark passes ``keep_ms`` after it."""

    def __init__(self, time: str, keep_ms: int, names: list[str]):
        self.time, self.keep_ms, self.names = time, keep_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at_ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.seen.exists():
            return
        known = (r for r in rows if r[self.time] is not None)
        first = min(known, key=lambda r: (r[self.time], *((r[n] is not None, r[n]) for n in self.names)), default=None)
        if first is None:
            return
        at = int(first[self.time].timestamp() * 1000)
        self.seen.update((at,))
        self.handle.registerTimer(max(at + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(**{n: first[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, by: list[str], time: str, delay: str, keep_ms: int) -> DataFrame:
    """The first row of each key, by time within the batch that brings it, and again once ``keep_ms`` have passed.

    A key's state is one number with a timer, which deletes it.  Ties are broken by the other columns' values; rows
    without a time are left out; null keys are keys.
    """
    ship_package(stream.sparkSession)
    seen = _FirstSeen(time, keep_ms, stream.columns)
    keyed = stream.withWatermark(time, delay).groupBy(*by)
    return keyed.transformWithState(seen, outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")


def run_batches(
    spark: SparkSession, batches: list[DataFrame], plan: Callable[[DataFrame], DataFrame], purpose: str = "stream",
    progress: list | None = None,
) -> DataFrame:
    """What ``plan`` emits over batches that arrive one after another.

    Each batch's files are added to a folder, and the query starts again from its checkpoint and ends when it has
    read them: a restart after every micro-batch.  ``progress`` gets what each run reports of itself.
    """
    space = Workspace(spark, purpose)
    files, sink, checkpoint = (space.path(n) for n in ("arrived", "emitted", "checkpoint"))
    with (
        setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB),
        setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"),
    ):
        out = None
        for batch in batches:
            batch.write.mode("append").parquet(files)
            out = plan(spark.readStream.schema(batches[0].schema).parquet(files))
            query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            query = query.outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            if progress is not None:
                progress.append(query.lastProgress)
    return spark.read.schema(out.schema).parquet(sink)
