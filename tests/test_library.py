"""Sources, sinks, intervals, incremental work and the catalogue."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import baselines, blocks, bootstrap, draws, duplicates, features, grid, indexing, manifests, metrics, models, validation
from spanloom.plans import catalogue, evaluation
from spanloom.sources import annotations, tables
from spanloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def write(folder, name, **doc):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / f"{name}.json").write_text(json.dumps(doc))


def test_annotations(spark, tmp_path):
    text = "A text."
    sha = hashlib.sha256(text.encode()).hexdigest()
    span = {"begin": 0, "end": 6, "label": "FACTS"}
    for name in ("Annotator_C", "annotator_A", "annotator_B"):
        own = {} if name == "annotator_B" else {"text": text, "text_sha256": sha}
        write(tmp_path / name, "M1", spans=[span], **own)
        write(tmp_path / name, "M2", canonical_case_id="case2", spans=[span | {"kind": "entity"}], **own)
    got = annotations.corpus(spark, f"file://{tmp_path}").collect()
    assert {(r.annotator, r.case_id, r.text) for r in got} == {(a, c, text) for a in ("Annotator_C", "annotator_A", "annotator_B") for c in ("M1", "case2")}
    kinds = annotations.spans(annotations.load(spark, f"file://{tmp_path}/Annotator_C")).select("kind").collect()
    assert {r.kind for r in kinds} == {"rhetorical", "entity"}
    write(tmp_path / "bad", "M1", text=text, text_sha256="0" * 64, spans=[])
    with pytest.raises(Exception, match="hash differs"):
        annotations.load(spark, f"file://{tmp_path}/bad").collect()


def test_manifests(tmp_path):
    path = str(tmp_path / "m.json")
    own = annotations.write_manifest(path, {"b": 1, "a": "é", "created_utc": "now"})
    assert annotations.digest({"a": "é", "b": 1}) == own
    with pytest.raises(FileExistsError):
        annotations.write_manifest(path, {})
    assert annotations.read_manifest(path)["a"] == "é"
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace('"b": 1', '"b": 2'))
    with pytest.raises(ValueError):
        annotations.read_manifest(path)


def test_dense_index(spark):
    ids = [5, 0, 10**6, 3, 10**12, 16384, 16383]
    got = indexing.dense_index(spark.createDataFrame([(i,) for i in ids + ids], "case_id long")).collect()
    assert {r.case_id: r.idx for r in got} == {i: k for k, i in enumerate(sorted(ids))}


def test_bootstrap(spark, tmp_path):
    sums = spark.createDataFrame([(i, 2, float(i % 3)) for i in range(30)], "case_id long, n long, total double")
    w = bootstrap.hash_weights(sums, 20)
    per = w.groupBy("rep").agg(F.sum("k").alias("s")).collect()
    assert len(per) == 20 and {r.s for r in per} == {30}
    got = bootstrap.interval(sums, w, bootstrap.mean, []).head()
    assert got.ci_low <= got.point == 0.5 <= got.ci_high and got.n_documents == 30
    again = bootstrap.interval(sums, draws.weights(sums, 20, 13, f"file://{tmp_path}"), bootstrap.mean, []).head()
    assert again.ci_low <= 0.5 <= again.ci_high
    same = sums.withColumn("total_a", F.col("total") + 2).withColumn("total_b", F.col("total")).drop("total")
    flat = bootstrap.interval(same, w, bootstrap.paired_mean, []).head()
    assert flat.ci_low == flat.point == flat.ci_high == 1.0


def test_duplicate_groups(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, "other words only here"), (4, base)], "case_id long, text string")
    found = duplicates.pairs(docs, f"file://{tmp_path}").collect()
    assert [(r.a, r.b) for r in found] == [(1, 2)]
    edges = spark.createDataFrame([(1, 2), (2, 5), (5, 9), (3, 4)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9, 11)], "case_id long")
    got = duplicates.components(nodes, edges, f"file://{tmp_path}")
    assert {r.case_id: r.root for r in got.collect()} == {1: 1, 2: 1, 5: 1, 9: 1, 3: 3, 4: 3, 11: 11}


def test_crf_learns_a_chain():
    rng = np.random.default_rng(0)
    seqs = []
    for _ in range(60):
        y = [int(rng.integers(2))]
        for _ in range(5):
            y.append(1 - y[-1])
        seqs.append(([np.array([v]) if k == 0 else np.array([2]) for k, v in enumerate(y)], y))
    model = models.Crf(2, 3).fit(seqs, epochs=20)
    assert all(model.viterbi(model.scores(f)) == y for f, y in seqs)
    node, edge, _ = model.marginals(model.scores(seqs[0][0]))
    assert np.allclose(node.sum(axis=1), 1) and np.isclose(edge.sum(), 5)


def test_codes_and_context(spark):
    df = spark.createDataFrame([("Roles: [DECISION_APPEAL, FACTS] not ISSUE",), ("DECISION or DECISION",), ("none",)], "a string")
    assert [r.c for r in df.select(features.parse_codes(F.col("a")).alias("c")).collect()] == [["DECISION_APPEAL", "FACTS"], ["DECISION"], []]
    pre, post = features.context(F.lit("alpha beta gamma delta"), F.lit(11).cast("long"), F.lit(16).cast("long"), 3)
    r = spark.range(1).select(pre.alias("pre"), post.alias("post")).head()
    assert (r.pre, r.post) == ("beta ", " delta")


def test_incremental(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    incremental.append_missing(rows, folder, "key", lambda df: df)
    incremental.append_missing(rows.unionByName(spark.createDataFrame([("c",)], "key string")), folder, "key", lambda df: df)
    assert sorted(r.key for r in incremental.results(spark, folder).collect()) == ["a", "b", "c"] and incremental.results(spark, folder).columns == ["key"]


def test_intervals_take_5000_replicates(spark, monkeypatch):
    asked, made = [], draws.replicates
    monkeypatch.setattr(draws, "replicates", lambda sums, reps, *more: asked.append(reps) or made(sums, reps, *more))
    for name in ("macro_ci", "bootstrap_ci_full", "paired_ci_full", "subset_ci_full", "contrast_table_full"):
        catalogue.QUERIES[name](spark, SF)
    assert asked == [5000] * 7
    given = [(i, 1 + i % 3, float(i * i % 7)) for i in range(9)]
    got = catalogue._ci(spark.createDataFrame(given, "case_id long, n long, total double"), bootstrap.mean, 5000).head()
    values = []
    for rep in range(5000):
        drawn = [given[int(hashlib.md5(f"13:{rep}:{k}".encode()).hexdigest()[:8], 16) % 9] for k in range(9)]
        values.append(sum(x[2] for x in drawn) / sum(x[1] for x in drawn))
    assert np.allclose([got.ci_low, got.ci_high], np.percentile(values, [2.5, 97.5]), atol=1e-6)


@pytest.mark.parametrize("n,reps", [(1, 3), (2, 50), (8, 40), (37, 5000), (1000, 60)])
def test_draws_are_those_of_numpy(spark, tmp_path, n, reps):
    """Bit by bit, over slices that end within replicates, and with documents in order of any key."""
    folder, rng = f"file://{tmp_path}", np.random.default_rng(13)
    expected = np.array([np.bincount(rng.integers(0, n, size=n), minlength=n) for _ in range(reps)])
    names = sorted(f"c{i * 7919 % 10007}" for i in range(n))
    docs = spark.createDataFrame([(c, float(i), 1) for i, c in enumerate(names)][::-1], "case_id string, total double, n int")
    size = max(64, n * reps // 10 // 2 * 2)
    got = np.zeros_like(expected)
    for r in draws.weights(docs, reps, 13, folder, size=size).collect():
        got[r.rep, names.index(r.case_id)] = r.k
    assert (got == expected).all()
    sums = np.array([[r.total, r.n] for r in draws.replicates(docs, reps, folder, 13, size=size).orderBy("rep").collect()])
    assert np.allclose(sums, expected @ np.stack([np.arange(n), np.ones(n)], axis=1))


def test_draws_that_are_passed_over():
    """A number of documents for which nearly a third of all halves goes, on every slice's own."""
    n, rng = 3 * 2**30 + 1, np.random.default_rng(13)
    kept = np.concatenate([draws.slice_draws(n, 13, k, 256) for k in range(20)])
    assert len(kept) < 0.8 * 20 * 256 and (kept == rng.integers(0, n, size=len(kept))).all()


def test_many_documents_meet_draws_in_a_shuffle(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, float(i * i % 11), 1) for i in range(90)], "case_id long, total double, n int")
    whole = draws.replicates(docs, 30, f"file://{tmp_path}", 5).orderBy("rep").collect()
    monkeypatch.setattr(draws, "SENT_BYTES", 100)
    assert draws.replicates(docs, 30, f"file://{tmp_path}", 5, size=128).orderBy("rep").collect() == whole
    assert draws.replicates(docs.limit(0), 10, f"file://{tmp_path}", 5).count() == 0
    assert draws.weights(docs.limit(0), 10, 5, f"file://{tmp_path}").count() == 0


def test_wide_intervals_against_numpy(spark, tmp_path):
    given = [(i, 1 + i % 4, float(i * 5 % 13)) for i in range(41)]
    sums = spark.createDataFrame(given, "case_id long, n long, total double")
    rng, size, total = np.random.default_rng(13), np.array([g[1] for g in given]), np.array([g[2] for g in given])
    values = [total[d].sum() / size[d].sum() for d in (rng.integers(0, 41, size=41) for _ in range(5000))]
    got = bootstrap.wide_interval(sums, 5000, bootstrap.mean, f"file://{tmp_path}").head()
    assert np.allclose([got.point, got.ci_low, got.ci_high], [total.sum() / size.sum(), *np.percentile(values, [2.5, 97.5])], atol=1e-6) and got.n_documents == 41


def test_manifests_and_fingerprints(spark):
    docs = spark.createDataFrame([("b", "One. Two."), ("a", "Three."), ("c", "...")], "case_id string, text string")
    cut = grid.sentences(docs)
    own = {r.case_id: r for r in manifests.grid_manifest(docs, cut).collect()}
    assert (own["b"].n_sentences, own["c"].n_sentences) == (2, 0) and own["b"].grid_sha256 == hashlib.sha256(b"[[0,4],[5,9]]").hexdigest()
    assert manifests.grid_fingerprint(cut) == hashlib.sha256(b'{"a":[[0,6]],"b":[[0,4],[5,9]]}').hexdigest()
    assert manifests.fingerprint({"b": "é", "a": [1]}, "split") == hashlib.sha256('{"a":[1],"b":"é"}'.encode()).hexdigest() == manifests.fingerprint({"b": "é", "a": [1], "created_utc": 1}, "split")
    assert manifests.fingerprint({"b": 1, "a": [1]}, "audit") == hashlib.sha256(b'{"a": [1], "b": 1}').hexdigest()
    halves = grid.segmented(docs, lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))]).orderBy("case_id", "sent_idx").collect()
    assert [(r.case_id, r.sent_idx, r.b, r.e) for r in halves] == [("a", 0, 0, 3), ("a", 1, 3, 6), ("b", 0, 0, 4), ("b", 1, 5, 9)]


def test_readers_of_splits_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", "LABELED", "train"), ("2", "y", "UNLABELED", "train"), ("3", "z", "LABELED", "test")], "id string, text string, status string, split string")
    annotations.write_split(rows, f"{tmp_path}/rows")
    read = lambda *splits, **more: sorted(r.id for r in annotations.read_split(spark, f"{tmp_path}/rows", rows.schema, *splits, **more).collect())
    assert read() == ["1", "2", "3"] and read("train") == ["1", "2"] and read("train", "test", status="LABELED") == ["1", "3"]
    one = spark.createDataFrame([("1", "c", ["FACTS"], [0.1234567] + [0.0] * 8), ("2", "c", [], [0.5] * 9)], annotations.SPAN_PREDICTIONS)
    annotations.write_predictions(one, f"{tmp_path}/pred")
    back = annotations.read_predictions(spark, f"{tmp_path}/pred")
    assert {r.id: r.probs[0] for r in back.collect()} == {"1": 0.123457, "2": 0.5}
    assert annotations.aligned(one, back.orderBy(F.desc("id"))).count() == 2
    for other in (back.filter("id = '1'"), back.withColumn("gold", F.array(F.lit("ISSUE")))):
        with pytest.raises(Exception, match="not the same examples"):
            annotations.aligned(one, other).collect()
    answers = spark.createDataFrame([("1", "c", ["FACTS"], ["ISSUE", "FACTS"]), ("2", "c", ["FACTS"], [])], "id string, case_id string, gold array<string>, codes array<string>")
    annotations.write_answers(answers, f"{tmp_path}/multi", True)
    assert {r.id: [k for k, v in enumerate(r.probs) if v] for r in annotations.read_predictions(spark, f"{tmp_path}/multi").collect()} == {"1": [1, 2], "2": []}
    annotations.write_answers(answers.withColumn("gold", F.lit("FACTS")), f"{tmp_path}/one", False, "ANALYSIS")
    assert {r.id: r.pred for r in annotations.read_predictions(spark, f"{tmp_path}/one", annotations.SENTENCE_PREDICTIONS).collect()} == {"1": "ISSUE", "2": "ANALYSIS"}


def test_mock_corpus_and_expected_texts(spark, tmp_path):
    annotations.mock_corpus(str(tmp_path))
    assert annotations.corpus(spark, f"file://{tmp_path}").count() == 12
    kept = annotations.normalised(spark, f"file://{tmp_path}/Annotator_C")
    assert kept.select("case_id").distinct().count() == 4 and kept.filter("label not between 0 and 8").count() == 0
    own = annotations.texts(spark, f"file://{tmp_path}/Annotator_C")
    assert annotations.texts(spark, f"file://{tmp_path}/Annotator_C", own).count() == 4
    with pytest.raises(Exception, match="not the expected text"):
        annotations.texts(spark, f"file://{tmp_path}/Annotator_C", own.withColumn("text_sha256", F.lit("0"))).collect()


def test_marker_is_found_at_any_depth(spark):
    df = spark.createDataFrame([({"a": ["x", "to be\ndeferred"]}, "l"), ({"Defer": ["x"]}, "l"), ({"a": ["deferral"]}, "l"), ({}, "DEFER")], "meta map<string,array<string>>, label string")
    assert [r.d for r in df.select(validation.has_defer(F.col("meta"), F.col("label")).alias("d")).collect()] == [True, True, False, True]


def test_catalogue(spark):
    missing = set(catalogue.ORACLES) - set(catalogue.QUERIES)
    assert not missing
    for name in ("projection_stats", "norm_summary", "slices"):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_scan_reads_only_what_it_needs(spark):
    plan = tables.cases(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,0)]" in plan


def test_entry_without_llm(monkeypatch):
    """As if the folders were not there, and as if what they import were not."""
    for missing in ("spanloom.llm", "corpus_pipeline", "public_tokenizers"):
        for name in [n for n in sys.modules if n.startswith("spanloom.llm") or n == "corpus_pipeline"]:
            monkeypatch.delitem(sys.modules, name)
        with monkeypatch.context() as m:
            m.setitem(sys.modules, missing, None)
            spec = importlib.util.spec_from_file_location("entry_alone", "__spark_entry__.py")
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
        assert module.oracle_sql() and "projection_stats" in module.queries() and "pipeline" not in module.queries()
        assert missing == "corpus_pipeline" or not any(k.startswith("op") and k[2].isdigit() for k in module.queries())


def test_regressions_reach_the_minimum():
    rng = np.random.default_rng(1)
    dense = rng.random((80, 6)) * (rng.random((80, 6)) < 0.6)
    cols, vals = [np.flatnonzero(r) for r in dense], [r[r != 0] for r in dense]
    x = baselines.Sparse.of(cols, vals, np.arange(6))
    assert np.allclose(x.dot(np.arange(6.0)), dense @ np.arange(6.0)) and np.allclose(x.back(np.ones(80)), dense.sum(axis=0))
    y = dense[:, 0] + 0.3 * rng.random(80) > 0.5
    for weight in baselines.WEIGHTS:
        w = baselines.fit_binary(x, y, 3.0, weight)
        each = np.where(y, 80 / (2 * y.sum()), 80 / (2 * (~y).sum())) if weight == "balanced" else np.ones(80)
        full = np.c_[dense, np.ones(80)]
        slope = w + 3.0 * full.T @ (each * (1 / (1 + np.exp(-full @ w)) - y))
        assert np.abs(slope).max() < 3e-3
    assert baselines.fit_binary(x, np.zeros(80, dtype=bool), 1.0, "balanced")[-1] == -50
    label = np.where(dense[:, 1] > 0.5, 2, np.where(dense[:, 2] > 0.5, 4, 7))
    w = baselines.fit_softmax(x, label, 10.0, "none")
    z = full @ w.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert p[:, [0, 1, 3, 5, 6, 8]].max() < 1e-9 and (p.argmax(axis=1) == label).mean() > 0.9
    own = (p - np.eye(9)[label])[:, [2, 4, 7]]
    slope = 10.0 * own.T @ full
    slope[:, :-1] += w[[2, 4, 7], :-1]
    assert np.abs(slope).max() < 1e-2


def test_vectors_and_baseline(spark, tmp_path):
    said = {1: "alpha beta", 2: "gamma delta", 4: "alpha gamma"}
    rows = [(f"{k}:{m}", "train" if k < 40 else "val" if k < 60 else "test", m, said[m & 3 if m & 3 in said else 4] if m != 3 else "alpha beta gamma delta") for k in range(80) for m in (1, 2, 3)]
    df = spark.createDataFrame([*rows, ("e:0", "test", 1, "")], "row string, part string, mask long, text string")
    known = {r.gram: (r.idx, r.idf) for r in baselines.vocabulary(df.filter("part = 'train'"), 2, 4).collect()}
    assert sorted(i for i, _ in known.values()) == list(range(len(known))) and " alp" in known and "a b" not in known
    df_ = spark.createDataFrame([(g, *v) for g, v in known.items()], "gram string, idx int, idf double")
    got = {r.row: r for r in baselines.vectors(df, df_, 2, 4).collect()}
    assert np.isclose(sum(v * v for v in got["5:3"].vals), 1) and got["5:3"].cols == sorted(got["5:3"].cols) and got["e:0"].cols == []
    tf: dict = {}
    for word in said[1].split():
        for n in (2, 3, 4):
            for i in range(len(word) + 3 - n):
                tf[f" {word} "[i : i + n]] = tf.get(f" {word} "[i : i + n], 0) + 1
    w = {known[g][0]: (1 + np.log(c)) * known[g][1] for g, c in tf.items()}
    norm = np.sqrt(sum(x * x for x in w.values()))
    assert got["5:1"].cols == sorted(w) and np.allclose(got["5:1"].vals, [w[i] / norm for i in sorted(w)])
    found, chosen = baselines.apply(df, f"file://{tmp_path}", softmax=False)
    assert chosen["strength"] in baselines.STRENGTHS and all(r.pred == r.mask for r in found.filter("row <> 'e:0'").collect())
    one, _ = baselines.apply(df.filter("mask <> 3"), f"file://{tmp_path}", softmax=True)
    assert all(r.pred == r.mask and abs(sum(r.p) - 1000) < 1e-6 for r in one.filter("row <> 'e:0'").collect())


def test_baselines_shuffle_no_grams_of_rows_and_count_decoded_rows(spark, tmp_path):
    odd = ["alpha  beta alpha", "", None, "x", "\u00e9\U0001f600\u3000ab\tcd", "beta gamma \u85de", "abc abcd abcde"]
    df = spark.createDataFrame([(f"{k}:{j}", "train" if k < 6 else "val", 1 << (j % 3), t) for k in range(8) for j, t in enumerate(odd)], "row string, part string, mask long, text string")
    for low, high in ((2, 4), (3, 5)):
        known = baselines.vocabulary(df.filter("part = 'train'"), low, high)
        grams = df.filter("part = 'train'").select("row", F.explode(features.char_grams(F.col("text"), low, high)).alias("gram")).groupBy("gram").agg(F.countDistinct("row").alias("df"))
        want = {r.gram: np.log((1 + 42) / (1 + r.df)) + 1 for r in grams.collect()}
        got = {r.gram: r.idf for r in known.collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[g], want[g]) for g in want)
    plan = baselines.vectors(df, known, 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in baselines.vectors(df, known, 2, 4)._jdf.queryExecution().executedPlan().toString()
    text = baselines.prepare(df, 3, 5, f"file://{tmp_path}", ("val",))
    assert {r.part for r in text.rows.select("part").distinct().collect()} == {"val"} and text.sample.n == 42
    for softmax in (False, True):
        fitted = baselines.fit(spark, text, baselines.SETTINGS[:2], softmax)
        scored = baselines.score(text.rows, text, fitted, softmax).withColumn("gold", F.col("mask")).withColumn("threshold", F.explode(F.array(*map(F.lit, [0] if softmax else metrics.THRESHOLDS))))
        scored = scored.withColumn("pred", metrics.bit(metrics.argmax(F.col("p"))) if softmax else metrics.decode(F.col("p"), F.col("threshold")))
        by = ["setting", "threshold"]
        counted = metrics.summary(baselines.tally(text.rows, text, fitted, softmax), by, F.col("n"))
        assert sorted(counted.collect()) == sorted(metrics.summary(scored, by).collect())


def test_crf_penalties():
    seqs = [([np.array([v]), np.array([2])], [v, 1 - v]) for v in (0, 1) for _ in range(30)]
    plain, sparse = models.Crf(2, 50).fit(seqs, 10), models.Crf(2, 50).fit(seqs, 10, c1=5.0)
    assert np.abs(sparse.w).sum() + np.abs(sparse.t).sum() < np.abs(plain.w).sum() + np.abs(plain.t).sum()
    assert all(plain.viterbi(plain.scores(f)) == y for f, y in seqs)


def test_fits_read_features_that_are_written_once(spark):
    d = "/root/testdata/sf0.001"
    rows = catalogue._featurised(spark, d, buckets=64)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and "text" not in rows.columns
    want = catalogue._texts(spark, d).filter(catalogue._split() != "val").select("case_id", "sent_idx", "label", "mask")
    assert sorted(rows.select(*want.columns).collect()) == sorted(want.collect()) and rows.head().features.size == 64
    assert all("/featurised/" in f for f in catalogue.QUERIES["ml_crf"](spark, d).inputFiles())


def test_context_of_long_words_and_odd_white_space(spark):
    """Words longer than what is looked at beside a window first, and white space of all kinds."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "b" * rng.choice([1, 1, 1, 200]), " ", "\n", "\t", "\x0b", "\u00a0", "😀"]) for _ in range(120)) for _ in range(40)]
    given = [(t, b, b + rng.randrange(1, 9)) for t in texts for b in (0, 3, rng.randrange(len(t) - 9), len(t) - 9)]
    df = spark.createDataFrame(given, "t string, b long, e long")
    pre, post = features.context(F.col("t"), F.col("b"), F.col("e"), 5)
    for r in df.select("t", "b", "e", pre.alias("pre"), post.alias("post")).collect():
        first, last = max(0, r.b - 5), min(len(r.t), r.e + 5)
        assert r.pre == re.search(r"(?a)\S*\Z", r.t[:first]).group() + r.t[first : r.b]
        assert r.post == r.t[r.e : last] + re.match(r"(?a)\S*", r.t[last:]).group()


def test_regions_of_several_uses_are_written_once(spark):
    """Each plan that reads regions several times reads written ones, and no longer makes them from spans again."""
    d = "/root/testdata/sf0.001"
    for name in ("audit_candidates", "grid_robustness"):
        plan = catalogue.QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(0, 11" not in plan and "prov" not in plan, name


def test_hash_intervals_gather_no_documents(spark, tmp_path):
    """Draws by documents' places give the same intervals; no documents are gathered for a broadcast, and draws are dealt once."""
    sums = spark.createDataFrame([(i * 7 - 40, 1 + i % 3, float(i % 5)) for i in range(90)], "case_id long, n long, total double")
    own = bootstrap.numbered(sums, f"file://{tmp_path}")
    assert [r.case_id for r in own.orderBy("case_id").collect()] == list(range(90))
    got = bootstrap.interval(own, bootstrap.place_weights(90, spark, 20), bootstrap.mean, [])
    assert got.collect() == bootstrap.interval(sums, bootstrap.hash_weights(sums, 20), bootstrap.mean, []).collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning(case_id") == 3  # of sums, of draws, and to count documents
    assert bootstrap.place_weights(0, spark, 20).count() == 0


def test_crfs_read_runs_that_are_written_once(spark):
    d = "/root/testdata/sf0.001"
    parts = evaluation._crf_parts(spark, d)
    assert all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in parts)
    want = evaluation._crf_rows(spark, d)
    assert sorted(r for p in parts for r in p.select("case_id", "sent_idx", "run", "label", "features").collect()) == sorted(want.select("case_id", "sent_idx", "run", "label", "features").collect())
