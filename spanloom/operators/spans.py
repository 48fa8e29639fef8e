"""Span algebra: normalisation, regions, nesting and crossing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import bit
from .intervals import overlap_join

TINY, NEAR = 5, 20


def is_tiny():
    """Rhetorical rows that are too short or have no letter."""
    return (F.col("kind") == "rhetorical") & ((F.col("e") - F.col("b") < TINY) | ~F.col("letter"))


def near_identical(spans: DataFrame) -> DataFrame:
    """Drop log of rows inside another of the same case and label, other bounds and nearly the same length; the kept one is the first by (begin, longest). A dropped row may still drop others."""
    own = spans.filter((F.col("kind") == "rhetorical") & ~is_tiny()).select("case_id", "label", "b", "e").distinct()
    inside = (F.col("l_label") == F.col("r_label")) & (F.col("l_b") <= F.col("r_b")) & (F.col("r_e") <= F.col("l_e")) & ((F.col("l_b") != F.col("r_b")) | (F.col("l_e") != F.col("r_e")))
    near = (F.col("l_e") - F.col("l_b")) - (F.col("r_e") - F.col("r_b")) <= NEAR
    pairs = overlap_join(own, own, inside & near)
    first = F.min(F.struct(F.col("l_b").alias("b"), (-F.col("l_e")).alias("e")))
    found = pairs.groupBy(F.col("r_case_id").alias("case_id"), F.col("r_label").alias("label"), F.col("r_b").alias("b"), F.col("r_e").alias("e")).agg(first.alias("kept"))
    return found.select("case_id", "label", "b", "e", F.col("kept.b").alias("kept_b"), (-F.col("kept.e")).alias("kept_e"))


def normalise(spans: DataFrame) -> DataFrame:
    """The rows that stay: other kinds all, rhetorical ones neither tiny nor near-identical."""
    gone = near_identical(spans).select("case_id", "label", "b", "e", F.lit("rhetorical").alias("kind"))
    return spans.filter(~is_tiny()).join(gone, ["case_id", "label", "b", "e", "kind"], "left_anti")


def regions(spans: DataFrame) -> DataFrame:
    """Rhetorical rows of the same bounds as one region: case_id, region_idx, b, e, mask of its labels."""
    grouped = spans.filter("kind = 'rhetorical'").groupBy("case_id", "b", "e").agg(F.bit_or(bit(F.col("label"))).alias("mask"))
    return grouped.withColumn("region_idx", (F.row_number().over(Window.partitionBy("case_id").orderBy("b", "e")) - 1).cast("long"))


def nesting(found: DataFrame) -> DataFrame:
    """Ordered pairs of which the first strictly contains the second: case_id, i, j, and whether they share a role."""
    inside = (F.col("l_b") <= F.col("r_b")) & (F.col("r_e") <= F.col("l_e")) & ((F.col("l_b") != F.col("r_b")) | (F.col("l_e") != F.col("r_e")))
    pairs = overlap_join(found, found, inside)
    return pairs.select(F.col("l_case_id").alias("case_id"), F.col("l_region_idx").alias("i"), F.col("r_region_idx").alias("j"), (F.col("l_mask").bitwiseAND(F.col("r_mask")) != 0).alias("same_role"))


def crossing(found: DataFrame) -> DataFrame:
    """Pairs of which each begins or ends strictly inside the other, but not both: case_id, i < j."""
    cross = (F.col("l_b") < F.col("r_b")) & (F.col("r_b") < F.col("l_e")) & (F.col("l_e") < F.col("r_e"))
    pairs = overlap_join(found, found, cross)
    return pairs.select(F.col("l_case_id").alias("case_id"), F.least("l_region_idx", "r_region_idx").alias("i"), F.greatest("l_region_idx", "r_region_idx").alias("j"))


def nesting_roles(found: DataFrame) -> DataFrame:
    """Regions with is_nested and nesting_role: both, outer, inner or none."""
    pairs = nesting(found)
    ends = pairs.select("case_id", F.col("i").alias("region_idx"), F.lit(1).alias("outer"), F.lit(0).alias("inner")).unionByName(pairs.select("case_id", F.col("j").alias("region_idx"), F.lit(0).alias("outer"), F.lit(1).alias("inner")))
    flags = ends.groupBy("case_id", "region_idx").agg(F.max("outer").alias("outer"), F.max("inner").alias("inner"))
    role = F.when((F.col("outer") == 1) & (F.col("inner") == 1), "both").when(F.col("outer") == 1, "outer").when(F.col("inner") == 1, "inner").otherwise("none")
    return found.join(flags, ["case_id", "region_idx"], "left").withColumn("nesting_role", role).withColumn("is_nested", F.col("nesting_role") != "none").drop("outer", "inner")
