"""Projecting region labels onto sentences by the characters that each role covers. Ties are never broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import N_ROLES, bit, covers, has
from .intervals import overlap_join


def hits(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """Sentences and the regions that share characters with them, clipped: case_id, sent_idx, region_idx, b, e, cb, ce, mask."""
    share = F.least("l_e", "r_e") > F.greatest("l_b", "r_b")
    pairs = overlap_join(grid, regions.select("case_id", "region_idx", "b", "e", "mask"), share)
    return pairs.select(F.col("l_case_id").alias("case_id"), F.col("l_sent_idx").alias("sent_idx"), F.col("r_region_idx").alias("region_idx"), F.col("r_b").alias("b"), F.col("r_e").alias("e"), F.greatest("l_b", "r_b").alias("cb"), F.least("l_e", "r_e").alias("ce"), F.col("r_mask").alias("mask"))


def union_length(df: DataFrame, keys: list[str], begin: str = "cb", end: str = "ce") -> DataFrame:
    """keys and cov, the length of the union of the intervals: each adds what lies beyond the furthest end before it."""
    w = Window.partitionBy(*keys).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(end).over(w), F.col(begin))
    return df.withColumn("add", F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(begin), before))).groupBy(*keys).agg(F.sum("add").cast("long").alias("cov"))


def coverage(hit: DataFrame) -> DataFrame:
    """case_id, sent_idx, role and the characters of the sentence that regions with the role cover."""
    each = hit.withColumn("role", F.explode(F.filter(F.sequence(F.lit(0), F.lit(N_ROLES - 1)), lambda r: has(F.col("mask"), r))))
    return union_length(each, ["case_id", "sent_idx", "role"])


def project(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """Every sentence with status, label (a role or null), the masks of roles present and of tied ones, and the kind of a tie."""
    hit = hits(grid, regions)
    most = coverage(hit).groupBy("case_id", "sent_idx").agg(F.collect_list(F.struct("role", "cov")).alias("c"))  # nine rows at most
    best = F.array_max(F.transform("c", lambda x: x["cov"]))
    mask = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x["role"])))
    decided = most.select("case_id", "sent_idx", mask(F.col("c")).alias("present"), mask(F.filter("c", lambda x: x["cov"] == best)).alias("tied"))
    tied = decided.filter(F.bit_count("tied") > 1)
    own = hit.join(tied.select("case_id", "sent_idx", "tied"), ["case_id", "sent_idx"])
    one = own.groupBy("case_id", "sent_idx").agg(F.max(covers(F.col("mask"), F.col("tied"))).alias("one"))
    a, b = own.alias("a"), own.alias("b")
    inside = ((F.col("a.b") <= F.col("b.b")) & (F.col("b.e") <= F.col("a.e"))) | ((F.col("b.b") <= F.col("a.b")) & (F.col("a.e") <= F.col("b.e")))
    same = (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.sent_idx") == F.col("b.sent_idx")) & (F.col("a.region_idx") < F.col("b.region_idx"))
    both = a.join(b, same & inside & covers(F.col("a.mask").bitwiseOR(F.col("b.mask")), F.col("a.tied"))).select(F.col("a.case_id").alias("case_id"), F.col("a.sent_idx").alias("sent_idx")).distinct().withColumn("pair", F.lit(True))
    kinds = one.join(both, ["case_id", "sent_idx"], "left").select("case_id", "sent_idx", F.when(F.col("one"), "co_extensive_multi_role").when(F.col("pair"), "nested").otherwise("other").alias("ambiguity_kind"))
    out = grid.join(decided, ["case_id", "sent_idx"], "left").join(kinds, ["case_id", "sent_idx"], "left")
    status = F.when(F.col("tied").isNull(), "UNLABELED").when(F.bit_count("tied") == 1, "LABELED").otherwise("AMBIGUOUS")
    label = F.when(F.bit_count("tied") == 1, F.log2(F.col("tied").cast("double")).cast("int"))
    return out.withColumns({"status": status, "label": label, "present": F.coalesce("present", F.lit(0).cast("long")), "tied": F.coalesce("tied", F.lit(0).cast("long"))})


def labelled(grid: DataFrame, regions: DataFrame) -> DataFrame:
    """case_id, sent_idx and label of the sentences that :func:`project` calls LABELED, without what only the others need."""
    most = coverage(hits(grid, regions)).groupBy("case_id", "sent_idx").agg(F.collect_list(F.struct("role", "cov")).alias("c"))  # nine rows at most
    best = F.array_max(F.transform("c", lambda x: x["cov"]))
    tied = F.filter("c", lambda x: x["cov"] == best)
    return most.select("case_id", "sent_idx", tied.alias("tied")).filter(F.size("tied") == 1).select("case_id", "sent_idx", F.get("tied", F.lit(0))["role"].alias("label"))


def stats(projected: DataFrame) -> DataFrame:
    """Counts and percentages of statuses, kinds of ties, and labels: section, name, n, pct."""
    n = Window.partitionBy("section")
    rows = projected.select(
        F.explode(F.filter(F.array(F.struct(F.lit("status").alias("section"), F.col("status").alias("name")), F.struct(F.lit("kind").alias("section"), F.col("ambiguity_kind").alias("name")), F.struct(F.lit("label").alias("section"), F.col("label").cast("string").alias("name"))), lambda x: x["name"].isNotNull())).alias("x")
    )
    counted = rows.groupBy(F.col("x.section").alias("section"), F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(n), 2))


STATUSES = {"UNLABELED": "unlabeled", "AMBIGUOUS": "ambiguous", "LABELED": "eligible"}
KINDS = ["co_extensive_multi_role", "nested", "other"]


def robustness(projected: DataFrame) -> DataFrame:
    """Of projections onto several grids (columns grid and split): sentences, statuses, kinds of ties, whether statuses add up, and the median length, by grid and split and by grid alone."""
    got = projected.groupingSets([["grid", "split"], ["grid"]], "grid", "split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("n_docs"), *(F.count_if(F.col("status") == k).alias(v) for k, v in STATUSES.items()), F.count_if(F.col("status") != "UNLABELED").alias("covered"),
        *(F.count_if(F.col("ambiguity_kind") == k).alias(k) for k in KINDS), F.percentile(F.col("e") - F.col("b"), 0.5).alias("median_length"),
    )
    return got.withColumn("split", F.coalesce("split", F.lit("all"))).withColumn("adds_up", F.col("n") == F.col("unlabeled") + F.col("ambiguous") + F.col("eligible"))


def moved(projected: DataFrame, first: str, second: str, points: float = 5.0) -> DataFrame:
    """The documents whose percentage of ambiguous sentences differs by more than so many points between two grids, the farthest first. A document without sentences on a grid has a rate of 0."""
    rate = lambda g: F.coalesce(F.round(100.0 * F.count_if((F.col("grid") == g) & (F.col("status") == "AMBIGUOUS")) / F.nullif(F.count_if(F.col("grid") == g), F.lit(0)), 2), F.lit(0.0))
    each = projected.groupBy("case_id", "split").agg(rate(first).alias("first_rate"), rate(second).alias("second_rate"), F.count_if(F.col("grid") == first).alias("first_n"), F.count_if(F.col("grid") == second).alias("second_n"))
    delta = F.round(F.col("second_rate") - F.col("first_rate"), 2)
    return each.withColumn("delta", delta).filter(F.abs("delta") > points).orderBy(F.abs("delta").desc(), "case_id")
