"""Queries on subwords: lengths of spans, windows of ids, and the cache of counts. They are beyond SQL; tests compare with plain longest match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import subwords
from .catalogue import _dealt, _docs, _regions, _split, query, shared_folder

#: Subwords that a window has room for beside its two special tokens.
LIMIT = 510


def _vocabulary() -> dict[str, int]:
    import public_tokenizers

    return subwords.vocabulary_of_words(public_tokenizers.path("word_bpe_49k.json"))


def _span_lengths(s: SparkSession, d: str) -> DataFrame:
    """Regions with n_subwords, through the cache."""
    rows = _dealt(_regions(s, d), "case_id", "region_idx").join(_docs(s, d), "case_id").select("case_id", "region_idx", T.slice_(F.col("text"), F.col("b"), F.col("e")).alias("text"))
    return subwords.cached_lengths(rows, f"{shared_folder(s)}/subwords", subwords.encoder(s, _vocabulary())).drop("text")


@query
def subword_lengths(s, d):
    """Subwords of each region."""
    return _span_lengths(s, d).select("case_id", "region_idx", F.col("n_subwords").cast("long").alias("n_subwords"))


@query
def subword_audit(s, d):
    """Median, 95th percentile, maximum and regions over the limit, by split and over all."""
    n = F.col("n_subwords")
    got = _span_lengths(s, d).withColumn("split", _split()).rollup("split").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(n, 0.5).alias("median"), F.round(F.percentile(n, 0.95), 6).alias("p95"), F.max(n).cast("long").alias("longest"), F.count_if(n > LIMIT).alias("over")
    )
    return got.withColumn("split", F.coalesce("split", F.lit("all")))


@query
def subword_windows(s, d):
    """Each document's windows of ids between special tokens, padded to the longest: how many, their lengths, and a digest of ids and masks."""
    v = _vocabulary()
    ids = subwords.encoder(s, v)(F.col("text"))
    made = _docs(s, d).select("case_id", ids.alias("ids")).select("case_id", "ids", subwords.padded(subwords.id_windows(F.col("ids"), v[subwords.FIRST], v[subwords.LAST], LIMIT), v[subwords.PAD]).alias("w"))
    digest = F.md5(F.concat_ws(";", F.transform("w", lambda x: F.concat(F.array_join(x["ids"].cast("array<string>"), ","), F.lit("|"), F.array_join(x["mask"].cast("array<string>"), "")))).cast("binary"))
    return made.select("case_id", F.size("ids").cast("long").alias("n_subwords"), F.size("w").cast("long").alias("n_windows"), F.size(F.get("w", F.lit(0))["ids"]).cast("long").alias("length"), digest.alias("digest"))
