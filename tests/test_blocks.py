"""The evaluation block against loops over resampled documents."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import blocks

ROLES = 9


def f1(gold, pred):
    return 2 * len(gold & pred) / (len(gold) + len(pred)) if gold or pred else 1.0


def macro(pairs):
    total = 0.0
    for r in range(ROLES):
        tp, fp, fn = (sum(k(r in g, r in p) for g, p in pairs) for k in (lambda a, b: a and b, lambda a, b: b and not a, lambda a, b: a and not b))
        total += 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    return total / ROLES


def rows_of(seed, documents=13):
    rng = random.Random(seed)
    out = []
    for c in range(documents):
        for _ in range(rng.randint(1, 6)):
            gold = set(rng.sample(range(ROLES), rng.choice([1, 1, 2, 3] if c % 3 else [1])))
            p = [min(999, rng.randrange(700) + (300 if r in gold else 0)) for r in range(ROLES)]
            out.append((c * 17 % 101, gold, p, rng.random() < 0.4))
    return out


def masks(x):
    return {r for r in range(ROLES) if x >> r & 1}


@pytest.fixture(scope="module")
def block(spark):
    rows = rows_of(7)
    df = spark.createDataFrame([(c, sum(1 << r for r in g), p, n) for c, g, p, n in rows], "case_id long, gold long, p array<long>, is_nested boolean")
    return rows, blocks.choose_threshold(df), df


def picked(p, t):
    return {r for r in range(ROLES) if p[r] >= t} or {p.index(max(p))}


def test_threshold_is_the_first_best(block):
    rows, threshold, _ = block
    means = {t: round(sum(f1(g, picked(p, t)) for _, g, p, _ in rows) / len(rows), 4) for t in range(50, 1000, 50)}
    assert threshold == min(t for t in means if means[t] == max(means.values()))


def test_scores_of_both_decodings(block):
    rows, t, df = block
    got = {(r.decoding, r.slice): r for r in blocks.scores(blocks.decoded(df, t)).collect()}
    slices = {"all": lambda g, n: True, "single": lambda g, n: len(g) == 1, "multi": lambda g, n: len(g) > 1, "nested": lambda g, n: n, "non_nested": lambda g, n: not n}
    assert len(got) == 10
    for name, test in slices.items():
        for decoding in ("multilabel", "forced_single"):
            pairs = [(g, picked(p, t if decoding == "multilabel" else 10_000)) for _, g, p, n in rows if test(g, n)]
            r = got[decoding, name]
            expected = [len(pairs), np.mean([f1(*x) for x in pairs]), macro(pairs), np.mean([g == p for g, p in pairs]), np.mean([len(g) for g, _ in pairs]), np.mean([len(p) for _, p in pairs])]
            assert np.allclose([r.n, r.set_f1, r.macro_f1, r.exact, r.gold_roles, r.pred_roles], expected, atol=1e-6)


def test_intervals_are_those_of_numpy(spark, block, tmp_path):
    rows, t, df = block
    got = {r.statistic: r for r in blocks.confidence(blocks.decoded(df, t), 300, f"file://{tmp_path}").collect()}
    make = {
        "set_f1": lambda x: np.mean([f1(g, picked(p, t)) for _, g, p, _ in x]),
        "macro_f1": lambda x: macro([(g, picked(p, t)) for _, g, p, _ in x]),
        "exact": lambda x: np.mean([g == picked(p, t) for _, g, p, _ in x]),
        "multilabel_minus_forced": lambda x: np.mean([f1(g, picked(p, t)) - f1(g, {p.index(max(p))}) for _, g, p, _ in x]),
    }
    many = [x for x in rows if len(x[1]) > 1]
    for name, statistic, held in [*((k, v, rows) for k, v in make.items()), ("multilabel_minus_forced_multi", make["multilabel_minus_forced"], many)]:
        docs = sorted({x[0] for x in held})
        rng = np.random.default_rng(13)
        values = [statistic([x for k in rng.integers(0, len(docs), size=len(docs)) for x in held if x[0] == docs[k]]) for _ in range(300)]
        r = got[name]
        assert np.allclose([r.point, r.ci_low, r.ci_high], [statistic(held), *np.percentile(values, [2.5, 97.5])], atol=1e-6) and r.n_documents == len(docs)
    assert got["multilabel_minus_forced_multi"].n_documents < got["set_f1"].n_documents


def test_no_rows(spark, block, tmp_path):
    _, t, df = block
    none = blocks.decoded(df.limit(0), t)
    assert blocks.scores(none).count() == 0
    assert all(r.point is None and r.n_documents == 0 for r in blocks.confidence(none, 20, f"file://{tmp_path}").collect())
    single = blocks.decoded(df.filter(F.bit_count("gold") == 1), t)
    assert {r.statistic: r.n_documents for r in blocks.confidence(single, 20, f"file://{tmp_path}").collect()}["multilabel_minus_forced_multi"] == 0
    with pytest.raises(ValueError):
        blocks.choose_threshold(df.limit(0))
