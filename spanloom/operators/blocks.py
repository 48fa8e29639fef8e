"""The evaluation block of a multi-label system: scores by slice of threshold decoding and of forced single labels on the same probabilities, and intervals over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import bit
from . import bootstrap, metrics


def choose_threshold(rows: DataFrame) -> int:
    """The threshold of the best set F1 on these rows; the lowest of several."""
    found = metrics.best(metrics.sweep(rows)).head()
    if found is None:
        raise ValueError("there are no rows to choose a threshold on")
    return found.threshold


def decoded(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows (gold, p) with the masks multilabel, of threshold decoding, and forced, of the best role alone."""
    return rows.withColumns({"multilabel": metrics.decode(F.col("p"), F.lit(threshold)), "forced": bit(metrics.argmax(F.col("p")))})


def scores(both: DataFrame) -> DataFrame:
    """decoding, slice and the summary of each, with mean numbers of gold and predicted roles."""
    each = both.withColumn("d", F.explode(F.array(F.struct(F.lit("multilabel").alias("decoding"), F.col("multilabel").alias("pred")), F.struct(F.lit("forced_single").alias("decoding"), F.col("forced").alias("pred")))))
    sliced = metrics.slices(each.select("gold", "is_nested", "d.decoding", "d.pred"))
    by = ["decoding", "slice"]
    sizes = sliced.groupBy(*by).agg(F.round(F.avg(F.bit_count("gold")), 6).alias("gold_roles"), F.round(F.avg(F.bit_count("pred")), 6).alias("pred_roles"))
    return metrics.summary(sliced, by).join(sizes, by)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0))


def confidence(both: DataFrame, reps: int, folder: str, seed: int = bootstrap.SEED) -> DataFrame:
    """statistic, point, ci_low, ci_high and n_documents: of set F1, macro F1 and exactness, and of multilabel less forced decoding, paired, over all rows and over those of several gold roles.

    The last is over the documents that have such rows, as only these are drawn then.
    """
    path = f"{folder}/decoded-{uuid.uuid4().hex}"
    many = F.bit_count("gold") > 1
    each = metrics.per_example(both.withColumn("pred", F.col("multilabel")))
    each = each.withColumn("forced_f1", metrics.set_f1(F.col("gold"), F.col("forced")))
    sums = each.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("set_f1").alias("f"), F.sum("exact").alias("x"), F.sum("forced_f1").alias("g"), *metrics.role_counts([]),
        F.count_if(many).alias("n_many"), F.coalesce(F.sum(F.when(many, F.col("set_f1"))), F.lit(0.0)).alias("f_many"), F.coalesce(F.sum(F.when(many, F.col("forced_f1"))), F.lit(0.0)).alias("g_many"),
    )
    sums.write.parquet(path)
    held = both.sparkSession.read.parquet(path)
    whole = {"set_f1": lambda: _ratio("f", "n"), "macro_f1": metrics.macro_f1, "exact": lambda: _ratio("x", "n"), "multilabel_minus_forced": lambda: (F.col("f") - F.col("g")) / F.col("n")}
    part = {"multilabel_minus_forced_multi": lambda: (F.col("f_many") - F.col("g_many")) / F.col("n_many")}
    first = bootstrap.intervals(held.drop("n_many", "f_many", "g_many"), reps, whole, folder, seed)
    second = bootstrap.intervals(held.filter("n_many > 0").select("case_id", "n_many", "f_many", "g_many"), reps, part, folder, seed)
    return first.unionByName(second)
