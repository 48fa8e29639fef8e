"""Confidence intervals by resampling whole documents.

Documents are summed up first; a replicate is a weighted sum of those sums, never a copy of
examples. The weights (replicate, document, times drawn) are shared by all statistics and systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from . import draws
from .indexing import dense_index

SEED, ALPHA = 13, 0.05
#: Distinct values of which each is a column of counts; with more, draws meet the values' rows.
MOST_VALUES = 128


def hash_weights(docs: DataFrame, reps: int, seed: int = SEED) -> DataFrame:
    """rep, case_id, k: as many draws with replacement as documents, each from a hash of seed, replicate and slot."""
    index = dense_index(docs)
    drawn = place_weights(index.count(), docs.sparkSession, reps, seed).withColumnRenamed("case_id", "idx")
    return drawn.join(index, "idx").select("rep", "case_id", "k")


def numbered(sums: DataFrame, folder: str) -> DataFrame:
    """The sums, written, with documents' places in order as their case_id: draws then need no table of places."""
    own = held(sums, folder)
    placed = own.hint("merge").join(dense_index(own), "case_id").drop("case_id").withColumnRenamed("idx", "case_id")
    return held(placed, folder)


def place_weights(n: int, spark: SparkSession, reps: int, seed: int = SEED) -> DataFrame:
    """The :func:`hash_weights` of n documents by their places. Draws are dealt by the document drawn, so that counting them and meeting its sums takes one shuffle."""
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "slot").cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    return slots.select("rep", draw.alias("case_id")).repartition("case_id").groupBy("rep", "case_id").agg(F.count(F.lit(1)).alias("k"))


def held(sums: DataFrame, folder: str) -> DataFrame:
    """The sums as written to the folder."""
    path = f"{folder}/sums-{uuid.uuid4().hex}"
    sums.write.parquet(path)
    return sums.sparkSession.read.schema(sums.schema).parquet(path)


def intervals(sums: DataFrame, reps: int, statistics: dict[str, Callable[[], Column]], folder: str, seed: int = SEED, alpha: float = ALPHA, places: int = 6) -> DataFrame:
    """statistic, point, ci_low, ci_high and n_documents of several statistics over the same replicates, by numpy's own draws."""
    columns = [c for c in sums.columns if c != "case_id"]
    path = f"{folder}/interval-{uuid.uuid4().hex}"
    sums.select("case_id", *(F.col(c).cast("double") for c in columns)).write.parquet(path)
    held = sums.sparkSession.read.parquet(path)
    apart = lambda df: df.select(*(c for c in df.columns if c in ("rep", "n_documents")), F.explode(F.array(*(F.struct(F.lit(name).alias("statistic"), f().alias("value")) for name, f in statistics.items()))).alias("x"))
    point = apart(held.agg(*(F.sum(c).alias(c) for c in columns), F.count(F.lit(1)).alias("n_documents"))).select("x.statistic", half_even(F.col("x.value"), places).alias("point"), "n_documents")
    values = apart(draws.replicates(held, reps, folder, seed)).select("x.statistic", "x.value")
    ends = values.groupBy("statistic").agg(half_even(F.percentile("value", alpha / 2), places).alias("ci_low"), half_even(F.percentile("value", 1 - alpha / 2), places).alias("ci_high"))
    return point.join(ends, "statistic", "left").select("statistic", "point", "ci_low", "ci_high", "n_documents")


def quantile_interval(values: DataFrame, reps: int, folder: str, q: float = 0.5, seed: int = SEED, alpha: float = ALPHA, places: int = 6) -> DataFrame:
    """point, ci_low, ci_high and n_documents of a quantile of all rows' values (case_id, value) over resampled documents: a statistic that no sums give.

    A document's equal values are counted first; a replicate's quantile is that of all values, each as
    often as its documents were drawn, and interpolates between neighbours as numpy does.
    """
    path = f"{folder}/values-{uuid.uuid4().hex}"
    values.filter(F.col("value").isNotNull()).groupBy("case_id", F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    held = values.sparkSession.read.parquet(path)
    point = held.agg(F.percentile("value", q, F.col("n")).alias("value"), F.countDistinct("case_id").alias("n_documents"))
    known = [r.value for r in held.select("value").distinct().limit(MOST_VALUES + 1).collect()]
    if 0 < len(known) <= MOST_VALUES:
        # How often a document has each value adds up like any sum, so draws need not meet the values' rows.
        counts = held.groupBy("case_id").agg(*(F.sum(F.when(F.col("value") == F.lit(v), F.col("n")).otherwise(0)).alias(f"v{k}") for k, v in enumerate(known)))
        each = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"v{k}").cast("long").alias("n")) for k, v in enumerate(known)))).alias("x")
        drawn = draws.replicates(counts, reps, folder, seed).select("rep", each).filter("x.n > 0").groupBy("rep").agg(F.percentile("x.value", q, F.col("x.n")).alias("value"))
    else:
        drawn = _drawn_values(held, reps, folder, q, seed)
    ends = drawn.agg(F.percentile("value", alpha / 2).alias("low"), F.percentile("value", 1 - alpha / 2).alias("high"))
    return point.crossJoin(ends).select(half_even(F.col("value"), places).alias("point"), half_even(F.col("low"), places).alias("ci_low"), half_even(F.col("high"), places).alias("ci_high"), "n_documents")  # one row each


def _drawn_values(held: DataFrame, reps: int, folder: str, q: float, seed: int) -> DataFrame:
    return held.join(draws.weights(held, reps, seed, folder), "case_id").groupBy("rep").agg(F.percentile("value", q, F.col("n") * F.col("k")).alias("value"))


def wide_interval(sums: DataFrame, reps: int, statistic: Callable[[], Column], folder: str, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """:func:`interval` of one group by :func:`intervals`, for thousands of replicates."""
    return intervals(sums, reps, {"": statistic}, folder, seed, alpha).drop("statistic")


def interval(sums: DataFrame, weights: DataFrame, statistic: Callable[[], Column], by: list[str], alpha: float = ALPHA) -> DataFrame:
    """point, ci_low, ci_high and n_documents by groups. sums has a row for each document (and group) with additive columns, from which statistic builds its value after summation."""
    columns = [c for c in sums.columns if c not in ("case_id", *by)]
    total = lambda weight: [F.sum(F.col(c) * weight).alias(c) for c in columns]
    point = sums.groupBy(*by).agg(*total(F.lit(1)), F.countDistinct("case_id").alias("n_documents")).select(*by, "n_documents", F.round(statistic(), 6).alias("point"))
    # Sums are a row a document, and their files much smaller than they are: the driver must not gather them for a broadcast.
    replicates = sums.hint("merge").join(weights, "case_id").groupBy(*by, "rep").agg(*total(F.col("k"))).select(*by, "rep", statistic().alias("value"))
    ends = replicates.groupBy(*by).agg(F.percentile("value", alpha / 2).alias("low"), F.percentile("value", 1 - alpha / 2).alias("high"))
    out = point.join(ends, by) if by else point.crossJoin(ends)  # one row each
    return out.select(*by, "point", F.round("low", 6).alias("ci_low"), F.round("high", 6).alias("ci_high"), "n_documents")


def mean() -> Column:
    return F.col("total") / F.col("n")


def paired_mean() -> Column:
    return (F.col("total_a") - F.col("total_b")) / F.col("n")
