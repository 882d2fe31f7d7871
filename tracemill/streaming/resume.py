"""Scoring of files as they arrive: the streaming form of an append-only checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.scoring import Scorer, pending, scored
from tracemill.workspace import exists


def score_arriving(
    spark: SparkSession, source: str, schema: str | T.StructType, scorer: Scorer, fields: str, key: list[str], sink: str, checkpoint: str
) -> StreamingQuery:
    """Score new JSON files once each; keys that the sink has without an error are skipped."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(key)
        if exists(spark, sink):
            rows = pending(rows, spark.read.parquet(sink).where("error IS NULL"), key)
        scored(rows, scorer, fields).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
