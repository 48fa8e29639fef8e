"""Decoding of probabilities and multi-label and single-label scores. Probabilities come in thousandths, so comparisons are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import N_ROLES, bit, has

THRESHOLDS = [50 * k for k in range(1, 20)]


def argmax(p: Column) -> Column:
    """The first role of the largest probability."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def decode(p: Column, threshold: Column) -> Column:
    """Mask of the roles that reach the threshold; the best one if none does."""
    picked = F.aggregate(F.transform(p, lambda x, r: F.when(x >= threshold, bit(r)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.when(picked == 0, bit(argmax(p))).otherwise(picked)


def set_f1(gold: Column, pred: Column) -> Column:
    total = F.bit_count(gold) + F.bit_count(pred)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.bit_count(gold.bitwiseAND(pred)) / F.nullif(total, F.lit(0)))


def per_example(df: DataFrame) -> DataFrame:
    """Examples with gold and pred masks get set_f1 and exact."""
    return df.withColumns({"set_f1": set_f1(F.col("gold"), F.col("pred")), "exact": (F.col("gold") == F.col("pred")).cast("double")})


def role_counts(by: list[str], times: Column | None = None) -> list[Column]:
    """Sums of tp, fp and fn of each role, as columns of one aggregation; with times, each row counts so often."""
    out = []
    count = F.count_if if times is None else lambda test: F.sum(F.when(test, times).otherwise(F.lit(0)))
    for r in range(N_ROLES):
        g, p = has(F.col("gold"), r), has(F.col("pred"), r)
        out += [count(g & p).alias(f"tp{r}"), count(~g & p).alias(f"fp{r}"), count(g & ~p).alias(f"fn{r}")]
    return out


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    total = 2 * tp + fp + fn
    return F.when(total == 0, 0.0).otherwise(2.0 * tp / F.nullif(total, F.lit(0)))


def macro_f1() -> Column:
    """The mean over all roles, absent ones counting 0."""
    total = F.lit(0.0)
    for r in range(N_ROLES):
        total = total + f1(F.col(f"tp{r}"), F.col(f"fp{r}"), F.col(f"fn{r}"))
    return total / N_ROLES


def micro_f1() -> Column:
    tp, fp, fn = (sum((F.col(f"{k}{r}") for r in range(1, N_ROLES)), F.col(f"{k}0")) for k in ("tp", "fp", "fn"))
    return f1(tp, fp, fn)


def summary(df: DataFrame, by: list[str], times: Column | None = None) -> DataFrame:
    """n, set_f1, macro_f1, micro_f1 and exact by groups, in one aggregation; with times, each row counts so often."""
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    mean = F.avg if times is None else lambda c: F.sum(F.col(c) * times) / n
    got = per_example(df).groupBy(*by).agg(n.alias("n"), mean("set_f1").alias("set_f1"), mean("exact").alias("exact"), *role_counts(by, times))
    return got.select(*by, "n", F.round("set_f1", 6).alias("set_f1"), F.round(macro_f1(), 6).alias("macro_f1"), F.round(micro_f1(), 6).alias("micro_f1"), F.round("exact", 6).alias("exact"))


def per_role(df: DataFrame, by: list[str]) -> DataFrame:
    got = df.groupBy(*by).agg(*role_counts(by))
    rows = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"tp{r}").alias("tp"), F.col(f"fp{r}").alias("fp"), F.col(f"fn{r}").alias("fn")) for r in range(N_ROLES)))
    out = got.select(*by, F.explode(rows).alias("x"))
    return out.select(*by, "x.role", "x.tp", "x.fp", "x.fn", F.round(f1(F.col("x.tp"), F.col("x.fp"), F.col("x.fn")), 6).alias("f1"))


def slices(df: DataFrame) -> DataFrame:
    """Rows once for each slice that they are in; slices overlap."""
    names = F.array(F.lit("all"), F.when(F.bit_count("gold") > 1, "multi").otherwise("single"), F.when(F.col("is_nested"), "nested").otherwise("non_nested"))
    return df.withColumn("slice", F.explode(names))


def sweep(df: DataFrame) -> DataFrame:
    """Mean set F1 (4 places) of each threshold, in one pass over the examples."""
    each = df.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).withColumn("pred", decode(F.col("p"), F.col("threshold")))
    return each.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(set_f1(F.col("gold"), F.col("pred"))), 4).alias("set_f1"))


def best(swept: DataFrame, by: str = "threshold", score: str = "set_f1") -> DataFrame:
    """The first strict maximum."""
    return swept.orderBy(F.desc(score), by).limit(1)
