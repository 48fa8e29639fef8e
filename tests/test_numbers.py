"""Rounding against Python's, and quantiles of resampled documents against numpy's."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.numbers import half_even
from spanloom.operators import bootstrap


@pytest.mark.parametrize("places", [0, 2, 4, 6])
def test_rounding_is_that_of_python(spark, places):
    rng = random.Random(places)
    given = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, -1.5, 1 / 32, 3 / 32, -1 / 32, 0.00115, 2.675, 1.005, 0.1 + 0.2, 1e15 + 0.5, 1e300, -1e22, 5e-324, 4.5e15, math.inf, -math.inf]
    given += [k / 640 for k in range(640)] + [k / 128 for k in range(-128, 128)] + [(2 * k + 1) / (2 * 10**places) for k in range(3000)]
    given += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(20_000)]
    given += [math.nextafter((2 * k + 1) / (2 * 10**places), side) for k in range(1000) for side in (0, 9e9)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i long, x double").select("i", half_even(F.col("x"), places).alias("r")).collect()
    for r in rows:
        x = given[r.i]
        expected = round(x, places) if math.isfinite(x) else x
        assert r.r == expected and math.copysign(1, r.r) == math.copysign(1, expected), (x, r.r, expected)
    odd = spark.createDataFrame([(None,), (math.nan,)], "x double").select(half_even(F.col("x"), places).alias("r")).collect()
    assert odd[0].r is None and math.isnan(odd[1].r)


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantiles_of_resampled_documents(spark, tmp_path, q):
    rng = random.Random(3)
    given = [(c * 3, rng.choice([0.0, 0.25, 0.5, 2 / 3, 1.0])) for c in range(17) for _ in range(rng.randint(1, 5))]
    docs, draw = sorted({c for c, _ in given}), np.random.default_rng(13)
    values = []
    for _ in range(400):
        values.append(np.percentile([v for k in draw.integers(0, len(docs), size=len(docs)) for c, v in given if c == docs[k]], 100 * q))
    df = spark.createDataFrame([*given, (0, None)], "case_id long, value double")
    got = bootstrap.quantile_interval(df, 400, f"file://{tmp_path}", q).head()
    expected = [np.percentile([v for _, v in given], 100 * q), *np.percentile(values, [2.5, 97.5])]
    assert np.allclose([got.point, got.ci_low, got.ci_high], expected, atol=1e-6) and got.n_documents == 17


def test_draws_meet_no_rows(spark, tmp_path, monkeypatch):
    """Neither a quantile of few values nor sums beyond the bound count draws in a shuffle."""
    from spanloom.operators import draws

    df = spark.createDataFrame([(i // 3, float(i % 4)) for i in range(60)], "case_id long, value double")
    whole = bootstrap.quantile_interval(df, 50, f"file://{tmp_path}").head()
    monkeypatch.setattr(draws, "SENT_BYTES", 100)
    monkeypatch.setattr(draws, "weights", lambda *a, **b: 1 / 0)
    assert bootstrap.quantile_interval(df, 50, f"file://{tmp_path}").head() == whole


def test_intervals_read_written_sums(spark):
    from spanloom.plans import catalogue

    plan = catalogue.contrast_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sent_idx" not in plan and "text" not in plan


def test_tfidf_shuffles_no_grams_of_documents(spark):
    from spanloom.operators import features

    df = spark.createDataFrame([(1, "Ein Wort, ein Wort \U0001f600x a"), (2, "wort  ein a\x1cb"), (3, ""), (4, "a b a ein")], "case_id long, text string")
    made = features.tfidf(df, least=2)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    grams = df.select("case_id", F.explode(features.char_grams(F.col("text"), 3, 4)).alias("gram"))
    often = grams.groupBy("gram").agg(F.countDistinct("case_id").alias("df")).filter("df >= 2")
    row = lambda x: {(r.case_id, r.gram): r.weight for r in x.collect()}
    assert row(made) == pytest.approx(row(features._met(df, often, 4, 3, 4))) and row(made)
