"""Dense numbers for keys, without a global sort in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 14


def dense_index(df: DataFrame, key: str = "case_id", name: str = "idx") -> DataFrame:
    """The distinct integer keys with their place in order, from 0: ranges of keys are counted, and the place within the range added."""
    keys = df.select(key).distinct().withColumn("_range", F.floor(F.col(key) / WIDTH))
    counts = keys.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # Ranges are summed in two levels, so that neither the running sum nor the rank sees all keys.
    group = F.floor(F.col("_range") / WIDTH)
    counts = counts.withColumn("_group", group)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_gn"))
    before = groups.withColumn("_gs", F.coalesce(F.sum("_gn").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_s", inner).join(before, "_group").select("_range", (F.col("_s") + F.col("_gs")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return keys.withColumn("_place", place).join(starts, "_range").select(key, (F.col("_start") + F.col("_place")).cast("long").alias(name))


def placed(df: DataFrame, keys: list[str], folder: str, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """All rows with their place in order of the keys, from 0, whatever the keys' types: the rows are dealt by ranges, written to the folder in order, and the partitions' sizes summed."""
    spark, path = df.sparkSession, f"{folder}/placed-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    numbered = dealt.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())  # partition in the upper bits, row in the lower 33
    numbered.write.parquet(path)
    held = spark.read.schema(numbered.schema).parquet(path).withColumn("_part", F.call_function("shiftright", "_at", F.lit(33)))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")
