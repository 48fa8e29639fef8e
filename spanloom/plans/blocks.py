"""Queries of the evaluation block: the threshold is chosen on val, scores and intervals are of test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, bootstrap, metrics
from .catalogue import FULL_REPS, _ci, _s1, _split, query, shared_folder
from .evaluation import _answer_sums
from .oracles import F1, ORACLES, SPLIT, SUMMARY, _decode, sql


def _block(s: SparkSession, d: str) -> DataFrame:
    rows = _s1(s, d)
    return blocks.decoded(rows.filter(_split() == "test"), blocks.choose_threshold(rows.filter(_split() == "val")))


@query
def s1_block_scores(s, d):
    return blocks.scores(_block(s, d))


_BITS = [f"(CASE WHEN p[{r + 1}] >= t THEN {1 << r}::BIGINT ELSE 0 END)" for r in range(9)]
_AT = "CASE WHEN (" + " | ".join(_BITS) + ") = 0 THEN (1::BIGINT << (list_position(p, list_max(p)) - 1)) ELSE (" + " | ".join(_BITS) + ") END"
_CHOSEN = "SELECT t FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, {F1} AS f FROM (SELECT gold, {_decode(t)} AS pred FROM s1 WHERE {SPLIT} = 'val')" for t in metrics.THRESHOLDS) + ") GROUP BY t ORDER BY round(avg(f), 4) DESC, t LIMIT 1"
ORACLES["s1_block_scores"] = sql(
    f"""SELECT decoding, slice, {SUMMARY}, round(avg(bit_count(gold)), 6) AS gold_roles, round(avg(bit_count(pred)), 6) AS pred_roles
    FROM (SELECT decoding, unnest(['all', CASE WHEN bit_count(gold) > 1 THEN 'multi' ELSE 'single' END, CASE WHEN is_nested THEN 'nested' ELSE 'non_nested' END]) AS slice, gold, pred
    FROM (SELECT 'multilabel' AS decoding, gold, is_nested, {_AT} AS pred FROM s1 , ({_CHOSEN}) WHERE {SPLIT} = 'test'
    UNION ALL SELECT 'forced_single', gold, is_nested, 1::BIGINT << (list_position(p, list_max(p)) - 1) FROM s1 WHERE {SPLIT} = 'test')) GROUP BY decoding, slice"""
)


@query
def s1_block_intervals(s, d):
    """5,000 replicates by numpy's own draws, which SQL does not have."""
    return blocks.confidence(_block(s, d), FULL_REPS, shared_folder(s))


@query
def answer_contrast_full(s, d):
    """The answers' set F1 less that of the first system, with 5,000 replicates."""
    return _ci(_answer_sums(s, d), bootstrap.paired_mean, FULL_REPS, shared_folder(s))


@query
def s1_median_interval(s, d):
    """The median set F1 of a region, with 5,000 replicates."""
    return bootstrap.quantile_interval(metrics.per_example(_s1(s, d, nested=False)).select("case_id", F.col("set_f1").alias("value")), FULL_REPS, shared_folder(s))
