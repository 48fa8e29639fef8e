"""Incremental work: only keys that a result table lacks are computed, in batches or from a stream.

A table of results lies in buckets by its key's hash, so that a batch reads only the keys of buckets
that its own keys fall in. One writer at a time holds the table, by a file that can be made once. A
stream keeps the keys that it has seen in its state, so a micro-batch costs what it brings, whatever the table
holds, and writes to a folder of its own number, which a replay overwrites.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a result table.
BUCKETS = 64
_LOCK = "_writer"


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done, each key once."""
    return rows.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


class Held:
    """The right to write to a folder: a file made by whoever comes first. Another writer waits, and takes over a file older than its patience, whose writer is gone."""

    def __init__(self, spark: SparkSession, folder: str, patience: float = 3600.0, pause: float = 0.5) -> None:
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{_LOCK}")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        # An instance of its own, without checksum files beside the file: two writers at once would leave one that fits neither.
        self.fs = jvm.org.apache.hadoop.fs.FileSystem.newInstance(self.path.toUri(), conf)
        self.fs.setVerifyChecksum(False)
        self.fs.setWriteChecksum(False)
        self.patience, self.pause, self.mark = patience, pause, uuid.uuid4().hex

    def __enter__(self) -> Held:
        while True:
            try:
                out = self.fs.create(self.path, False)  # fails where the file is
                out.write(bytearray(self.mark.encode()))
                out.close()
                time.sleep(self.pause)
                if self._owner() == self.mark:  # where making a file is not exclusive, the last of those at once has it
                    return self
            except Exception as error:
                if "exist" not in str(error).lower():
                    raise
            try:
                old = time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000
            except Exception:  # it went meanwhile
                continue
            if old > self.patience:
                self.fs.delete(self.path, False)
            else:
                time.sleep(self.pause)

    def _owner(self) -> str | None:
        try:
            file = self.fs.open(self.path)
            try:
                return bytes(file.readNBytes(64)).decode()
            finally:
                file.close()
        except Exception:  # it went meanwhile
            return None

    def __exit__(self, *_: object) -> None:
        if self._owner() == self.mark:
            self.fs.delete(self.path, False)


def _bucket(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def append_missing(rows: DataFrame, folder: str, key: str, work: Callable[[DataFrame], DataFrame], patience: float = 3600.0) -> None:
    """Appends the work on missing keys to a table, which may not exist yet. Of two runs at once, the later finds what the earlier wrote."""
    spark = rows.sparkSession
    with Held(spark, folder, patience) as held:
        todo = rows.dropDuplicates([key])
        if [s for s in held.fs.listStatus(held.path.getParent()) if s.getPath().getName().startswith("_bucket=")]:
            own = [r[0] for r in todo.select(_bucket(key)).distinct().collect()]  # as many as there are buckets at most
            todo = missing(todo, spark.read.parquet(folder).filter(F.col("_bucket").isin(own)), key)
        # A bucket's rows are dealt to one task, which writes one file: otherwise every task writes a file to every bucket.
        work(todo).withColumn("_bucket", _bucket(key)).repartition(BUCKETS, "_bucket").write.mode("append").partitionBy("_bucket").parquet(folder)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """A table of results, without the columns of its folders."""
    return spark.read.parquet(folder).drop("_bucket", "_batch")


def stream_missing(rows: DataFrame, folder: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]):
    """The same for a stream of rows, whose state knows the keys seen; returns the running query. The folder belongs to this stream alone."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/_batch={number}")

    once = rows.dropDuplicates([key])
    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
