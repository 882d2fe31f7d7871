"""Tables that cut lineage, and files beside them, in folders that every machine of a cluster sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


class Workspace:
    """Tables that cut lineage, in the folder the cluster shares.

    The folder is ``spark.checkpoint.dir``.  Where that is unset, a local one is made if everything runs in
    one JVM, as in tests; on a cluster, whose machines would not share it, that is an error.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
            if not _own_dir:
                _own_dir.append(f"file://{tempfile.mkdtemp(prefix='tracemill-')}")
            base = _own_dir[0]
        self.spark, self.root = spark, f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return what reads it back."""
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(self.path(name))
        return self.load(df, name)

    def load(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def save_sorted(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Write ``df`` in buckets sorted by ``keys``, so that merges of such tables neither shuffle nor sort.

        Rows should come dealt by ``keys`` to as many partitions as there are buckets: then each bucket is one
        file.  Otherwise a bucket has several files, and what reads it sorts again.
        """
        writer = df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path(name))
        writer.saveAsTable(self._bucketed(name))
        return self.spark.table(self._bucketed(name))

    def _bucketed(self, name: str) -> str:
        return f"{self.root.rsplit('/', 1)[-1]}_{name}".replace("-", "_")

    def drop_sorted(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._bucketed(name)}")
        self.drop(*names)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, self.path(name))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the plans that are made and run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system, of whatever kind Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return bool(store.exists(at))


def delete(spark: SparkSession, path: str) -> None:
    store, at = _path(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, at = _path(spark, path)
    if not store.rename(at, _path(spark, to)[1]):
        raise OSError(f"{path} could not become {to}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any store that Spark reads."""
    store, at = _path(spark, path)
    stream = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and moved there whole; parents are made."""
    store, at = _path(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = store.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    store.delete(at, False)
    if not store.rename(beside, at):
        raise OSError(f"{path} could not be written")
