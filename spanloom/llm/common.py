"""Shared-folder tables and small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _LOCAL[app]


class Scratch:
    """Written tables that cut lineage. A lost executor costs only the tasks that it ran, as the files lie in the shared folder.

    The session's end deletes what :meth:`drop` has not, since lazily returned results may read a table until then.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def documents(spark: SparkSession, sf_dir: str, *columns: str, table: str = "documents") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], key: str, limit: int | None = None) -> Iterator[pa.Table]:
    """The groups of batches whose rows come sorted by key, across batch borders, a group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        values = column.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(key)[-1].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives the memory that a task no longer holds back to the machine. Workers are reused, so what one task held at its peak would stay beside the memory of all later stages."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return then


#: Keys (24 bytes each) up to this number are broadcast to the rows that they take away; more meet them in a shuffle.
BROADCAST_KEYS = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has such a column already (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, the document's id with its text's hash, and text: rows that agree in both get the same decision."""
    body = F.col(text).cast("string")
    return docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("hash")).alias("_key"), body.alias("text"))


def without(docs: DataFrame, keys: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose :func:`keyed` key is not among keys; all columns stay."""
    held = Scratch(docs.sparkSession, name).table(keys.select(F.col("_key.id").alias("id"), F.col("_key.hash").alias("hash")).distinct(), "dropped")
    id_, hash_, own = fresh(docs, "_id", "_hash", "_own")
    held = held.select(F.col("id").alias(id_), F.col("hash").alias(hash_))
    if held.count() <= BROADCAST_KEYS:
        held = F.broadcast(held)
    left = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return left.join(held, F.col(key).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)), "left_anti").drop(own)
