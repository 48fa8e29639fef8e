"""Interval joins within a key, by bins.

Both sides are exploded to the bins that they touch and meet on (key, bin); a pair counts only in
the first bin that both touch, so none comes twice. The equi key keeps the plan a hash or merge
join, and bins keep long keys from comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 256


def _binned(df: DataFrame, prefix: str, begin: str, end: str, key: str, size: int) -> DataFrame:
    first, last = (F.col(begin) / size).cast("long"), ((F.greatest(F.col(end), F.col(begin) + 1) - 1) / size).cast("long")
    out = df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns), F.col(key).alias(f"{prefix}key"), first.alias(f"{prefix}first"), F.explode(F.sequence(first, last)).alias(f"{prefix}bin"))
    return out


def overlap_join(left: DataFrame, right: DataFrame, condition: Column, begin: tuple[str, str] = ("b", "b"), end: tuple[str, str] = ("e", "e"), key: str = "case_id", size: int = BIN) -> DataFrame:
    """Pairs of rows of one key whose intervals touch a common bin and satisfy condition, with columns prefixed l_ and r_."""
    a, b = _binned(left, "l_", begin[0], end[0], key, size), _binned(right, "r_", begin[1], end[1], key, size)
    meet = (F.col("l_key") == F.col("r_key")) & (F.col("l_bin") == F.col("r_bin"))
    return a.join(b, meet & (F.col("l_bin") == F.greatest("l_first", "r_first")) & condition).drop("l_key", "r_key", "l_bin", "r_bin", "l_first", "r_first")
