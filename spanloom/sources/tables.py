"""Tables of the driver, and annotated spans and predictions derived from them by integer arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import N_ROLES
from ..functions.text import LETTER, slice_


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cases(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as cases: case_id, n_chars and the named columns. A document without text, or without a count of its characters, is no case, as it can carry no span."""
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars", *columns)
    return docs.filter("n_chars > 0").withColumnRenamed("doc_id", "case_id")


def modelling(docs: DataFrame, excluded: Sequence[object]) -> DataFrame:
    """The cases without those that are left out of modelling by id."""
    return docs.filter(~F.col("case_id").isin(list(excluded))) if excluded else docs


def spans(spark: SparkSession, sf_dir: str, letters: bool = False) -> DataFrame:
    """case_id, b, e, label, kind, prov of twelve spans a case and those derived from them; with letters also whether the slice has a letter.

    Derived: the same bounds with the next label, a near-identical one, a nested one, a tiny one.
    """
    docs = cases(spark, sf_dir, *(["text"] if letters else []))
    k, b, e, r = F.col("k"), F.col("b"), F.col("e"), F.col("r")
    docs = docs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    docs = docs.withColumn("b", (F.col("case_id") * 37 + k * 101) % F.col("n_chars"))
    docs = docs.withColumn("e", F.least("n_chars", b + 20 + (F.col("case_id") * 13 + k * 29) % 200)).withColumn("r", (F.col("case_id") + k * k) % N_ROLES)
    row = lambda begin, end, label, kind="rhetorical": F.struct(begin.alias("b"), end.alias("e"), label.alias("label"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))
    made = F.array(
        row(b, e, r, F.when(k == 11, "entity").otherwise("rhetorical")),
        F.when(k % 4 == 0, row(b, e, (r + 1) % N_ROLES)),
        F.when((k % 4 == 1) & (e - b > 30), row(b + 3, e, r)),
        F.when((k % 4 == 2) & (e - b > 40), row(b + 10, e - 10, (r + 2) % N_ROLES)),
        F.when(k % 6 == 5, row(b, F.least("n_chars", b + 3), r)),
    )
    out = docs.withColumn("s", F.explode(F.filter(made, lambda x: x.isNotNull())))
    held = [F.col("case_id"), *(F.col(f"s.{c}").alias(c) for c in ("b", "e", "label", "kind")), ((F.col("case_id") + k) % 4).alias("prov")]
    if letters:
        held.append(slice_(F.col("text"), F.col("s.b"), F.col("s.e")).rlike(LETTER).alias("letter"))
    return out.select(*held)


def score(system: int, unit: str, role: int):
    """A system's probability of a role for a unit of a case, in thousandths."""
    return (F.col("case_id") * 31 + F.col(unit) * 17 + F.lit(role) * (F.lit(7) + F.col("case_id") % 5) * 13 + F.lit(system * 101)) % 1000


def predictions(units: DataFrame, unit: str, system: int) -> DataFrame:
    """The units with p, nine probabilities in thousandths."""
    return units.withColumn("p", F.array(*(score(system, unit, r).cast("long") for r in range(N_ROLES))))


def split_of(case_id):
    """train, val or test by the id: seven, one and two of ten."""
    return F.when(case_id % 10 < 7, "train").when(case_id % 10 == 7, "val").otherwise("test")
