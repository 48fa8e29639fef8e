"""The pipeline over planted cases."""

from __future__ import annotations

import inspect
import random

import pytest

import corpus_pipeline


def test_stages_keep_clean_documents_and_take_planted_ones(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels, toxic = [], [], set()
    for i in range(240):
        bad = i % 6 == 0
        text = say(50) + (" " + " ".join(rng.choice(["vilea", "vileb", "vilec", "viled"]) for _ in range(4)) if bad else "")
        if i % 6 == 1:
            text += "\nA line that many share"
        if bad:
            toxic.add(i)
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(bad)))
    passage = say(25)
    rows.append((500, f"{say(20)} {passage} {say(20)}", "en", "src1", 1))
    near = say(120)
    rows += [(600, near, "en", "s", 1), (601, near + " end", "en", "s", 1), (602, near, "en", "s", 1), (602, near, "en", "s", 1), (700, None, None, None, None), (701, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        counts.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name == "line_dedup":
            assert all("many share" not in (r.text or "") for r in docs.collect())
            assert all(r.n_chars == len(r.text) for r in docs.filter("doc_id % 6 = 1 and doc_id < 240").collect())
    clean = {i for i in range(240)} - toxic
    assert set(counts[0]) >= clean and not toxic & set(counts[0])
    assert counts[1] == counts[0]
    assert set(counts[2]) == set(counts[1]) - {601, 602}
    assert set(counts[3]) == set(counts[2]) - {500}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == counts[3] and all(r.n_tokens == len(r.ids) for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_near_duplicates_of_repeated_ids_and_rows_without_id(spark):
    """Against brute force over (id, text): unrelated texts under one id stay, one of each group, and one of each repeated row."""
    rng = random.Random(11)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " end", "en", "s", 1), (3, c, "fr", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1)]
    rows += [(None, d, "en", "s", 1), (None, d + " end", "en", "s", 1), (9, d + " more end", "en", "s", 1), (None, None, "x", None, None), (None, "", "x", None, 0), (5, None, None, None, None), (6, "", None, None, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    key = lambda r: tuple((x is not None, x) for x in r)
    # Null and empty texts link with nothing; as rows they agree in id and text, and the least of them stays.
    want = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (3, c, "en", "s", 1), (9, d + " more end", "en", "s", 1), (None, None, "x", None, None), (5, None, None, None, None), (6, "", None, None, None)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    extra = SCHEMA + ", _gone int, _own int, _id string, hash int"
    spark.createDataFrame([], extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 1, 2, "x", 4), (2, "c d", "en", "s", 3, 1, 2, "x", 4)], extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect())), name


def test_workers_give_memory_back(monkeypatch):
    """Workers are reused by later stages: each task of the stages' operators ends by giving back what it no longer holds, also when it fails or is left early."""
    from spanloom.llm import bpe, common, components, decontaminate, jaccard_join, toxicity

    for module in (bpe, components, decontaminate, jaccard_join, toxicity):
        source = inspect.getsource(module)
        assert source.count(".mapInArrow(") == source.count(".mapInArrow(common.lean(") > 0
    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6] and len(given) == 2
    left = common.lean(lambda batches: (1 // b for b in batches))
    with pytest.raises(ZeroDivisionError):
        list(left(iter([1, 0])))
    early = left(iter([1, 1]))
    next(early)
    early.close()
    assert len(given) == 6
