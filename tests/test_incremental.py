"""Result tables under two writers at once, and streams that start again."""

from __future__ import annotations

import os
import threading
import time
from collections import Counter

import pytest

from spanloom.streaming import incremental as I


def test_two_writers_leave_each_key_once(spark, tmp_path):
    folder, slow = f"file://{tmp_path}/out", []

    def work(df):
        slow.append(1)
        return df

    runs = [spark.createDataFrame([(k, k % 7) for k in range(a, a + 60)], "key long, v long") for a in (0, 30, 15)]
    threads = [threading.Thread(target=I.append_missing, args=(df, folder, "key", work)) for df in runs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert Counter(r.key for r in I.results(spark, folder).collect()) == Counter(range(90)) and len(slow) == 3
    I.append_missing(runs[0], folder, "key", work)
    assert I.results(spark, folder).count() == 90
    assert not os.path.exists(f"{tmp_path}/out/_writer")


def test_only_own_buckets_are_read(spark, tmp_path, monkeypatch):
    folder, read = f"file://{tmp_path}/out", []
    I.append_missing(spark.range(400).selectExpr("id AS key"), folder, "key", lambda df: df)
    plain = I.missing
    monkeypatch.setattr(I, "missing", lambda rows, done, key: read.append(done.select("_bucket").distinct().count()) or plain(rows, done, key))
    I.append_missing(spark.range(398, 401).selectExpr("id AS key"), folder, "key", lambda df: df)
    assert read[0] <= 3 < spark.read.parquet(folder).select("_bucket").distinct().count()
    assert sorted(r.key for r in I.results(spark, folder).collect()) == list(range(401))


def test_a_writer_that_is_gone_is_passed_over(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "_writer").write_text("gone")
    os.utime(folder / "_writer", (time.time() - 100, time.time() - 100))
    I.append_missing(spark.range(3).selectExpr("id AS key"), f"file://{folder}", "key", lambda df: df, patience=50)
    assert I.results(spark, f"file://{folder}").count() == 3
    with pytest.raises(ZeroDivisionError):
        I.append_missing(spark.range(4).selectExpr("id AS key"), f"file://{folder}", "key", lambda df: 1 // 0)
    assert not (folder / "_writer").exists()  # a failed run lets go


def test_streams_go_on_and_replay(spark, tmp_path):
    """Keys come once over several starts; a batch whose number was not kept is written over, not twice."""
    source, out, log = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/log"
    make = lambda lo, hi: spark.createDataFrame([(f"k{i % 10}", i) for i in range(lo, hi)], "key string, v long").coalesce(1).write.mode("append").parquet(str(source))

    def go():
        rows = spark.readStream.schema("key string, v long").parquet(str(source))
        query = I.stream_missing(rows, out, log, "key", lambda df: df.selectExpr("key", "length(key) AS n"))
        query.awaitTermination()

    make(0, 6)
    go()
    assert sorted(r.key for r in I.results(spark, out).collect()) == [f"k{i}" for i in range(6)]
    make(3, 23)
    go()
    whole = [f"k{i}" for i in range(10)]
    assert sorted(r.key for r in I.results(spark, out).collect()) == whole
    commits = sorted(p for p in os.listdir(f"{tmp_path}/log/commits") if p.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the driver had died before it noted the last batch
        path = f"{tmp_path}/log/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    go()
    assert sorted(r.key for r in I.results(spark, out).collect()) == whole
