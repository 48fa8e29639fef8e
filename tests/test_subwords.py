"""Subwords against plain longest match, one word at a time."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import subwords as S


def plain(word, vocabulary):
    """The longest known beginning again and again; unknown as a whole where none is."""
    out, at = [], 0
    while at < len(word) and len(word) <= S.LONGEST:
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(vocabulary[piece])
                at = end
                break
        else:
            return [vocabulary[S.UNKNOWN]]
    return out or [vocabulary[S.UNKNOWN]]


def made_up(seed, n=300, alphabet="abcdéж中"):
    rng = random.Random(seed)
    pieces = [S.PAD, S.UNKNOWN, S.FIRST, S.LAST]
    for _ in range(n):
        pieces.append(("##" if rng.random() < 0.5 else "") + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))))
    return {p: k for k, p in enumerate(dict.fromkeys(pieces))}


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdéж中"), (2, "ab"), (3, "abcdefghijklmnopqrstuvwxyz😀")])
def test_pieces_are_the_longest(seed, alphabet):
    vocabulary, rng = made_up(seed, alphabet=alphabet), random.Random(seed)
    words = ["".join(rng.choice(alphabet + "z") for _ in range(rng.randint(1, 14))) for _ in range(2000)] + ["", "a" * 100, "a" * 101, "#"]
    edge = np.cumsum([0, *map(len, words)])
    ids, count = S.Trie(vocabulary).pieces(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), edge)
    cuts = np.cumsum(count)[:-1]
    assert [x.tolist() for x in np.split(ids, cuts)] == [plain(w, vocabulary) for w in words]


def test_no_piece_goes_on():
    vocabulary = {S.UNKNOWN: 0, "a": 1, "ab": 2}
    words = ["ab", "a", "aa", "b"]
    ids, count = S.Trie(vocabulary).pieces(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), np.cumsum([0, *map(len, words)]))
    assert ids.tolist() == [2, 1, 0, 0] and count.tolist() == [1, 1, 1, 1]


def test_texts(spark):
    vocabulary = made_up(5)
    given = [None, "", "  ", "Abcd, ÉÉ!", "ab\tcd\nab", "жж中a" * 30, "x" * 200, "éa", "a😀b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id long, text string")
    got = {r.id: r for r in df.select("id", S.words(F.col("text")).alias("words"), S.encoder(spark, vocabulary)(F.col("text")).alias("ids")).collect()}
    assert got[3].words == ["abcd", ",", "éé", "!"] and got[8].words == ["a", "😀", "b"] and got[7].words == ["éa"]
    for r in got.values():
        assert (r.ids or []) == [i for w in r.words or [] for i in plain(w, vocabulary)]


def test_cache_cuts_each_text_once(spark, tmp_path):
    vocabulary, folder, asked = made_up(6), f"file://{tmp_path}/cache", []
    encode = S.encoder(spark, vocabulary)
    df = spark.createDataFrame([(1, "ab cd"), (2, "ab cd"), (3, None), (4, "")], "id long, text string")
    first = {r.id: r.n_subwords for r in S.cached_lengths(df, folder, encode).collect()}
    n = sum(len(plain(w, vocabulary)) for w in ("ab", "cd"))
    assert first == {1: n, 2: n, 3: None, 4: 0}
    assert spark.read.parquet(folder).count() == 2
    more = df.unionByName(spark.createDataFrame([(5, "a b c")], "id long, text string"))

    def counted(column):
        asked.append(column)
        return encode(column)

    again = {r.id: r.n_subwords for r in S.cached_lengths(more, folder, counted).collect()}
    assert again == first | {5: sum(len(plain(w, vocabulary)) for w in "abc")}
    assert spark.read.parquet(folder).count() == 3


def test_windows_and_padding(spark):
    df = spark.createDataFrame([(n, list(range(100, 100 + n))) for n in (0, 1, 5, 6, 7, 12)], "n int, ids array<int>")
    w = S.id_windows(F.col("ids"), 2, 3, size=5, overlap=2)
    for r in df.select("n", "ids", w.alias("w"), S.padded(w, 0).alias("p"), S.padded(w, 0, F.lit(9)).alias("q")).collect():
        expected, at = [], 0
        while True:
            expected.append([2, *r.ids[at : at + 5], 3])
            if at + 5 >= r.n:
                break
            at += 3
        assert r.w == expected
        longest = max(map(len, expected))
        for got, to in ((r.p, longest), (r.q, 9)):
            assert [(x.ids, x["mask"]) for x in got] == [(e + [0] * (to - len(e)), [1] * len(e) + [0] * (to - len(e))) for e in expected]


def test_vocabulary_of_words(tmp_path):
    path = tmp_path / "words.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b</w>": 2, "a</w>": 1, "Ã©</w>": 3, "Ã": 4, "<|x|>": 5}}}', encoding="utf-8")
    made = S.vocabulary_of_words(str(path))
    assert list(made) == [S.PAD, S.UNKNOWN, S.FIRST, S.LAST, "a", "##a", "b", "##b", "é", "##é", "<|x|>", "##<|x|>"]
    plain_path = tmp_path / "vocab.txt"
    plain_path.write_text("[PAD]\n[UNK]\n##a\n", encoding="utf-8")
    assert S.read_vocabulary(str(plain_path)) == {"[PAD]": 0, "[UNK]": 1, "##a": 2}


def test_a_batch_is_encoded_in_slices(spark, monkeypatch):
    """What is held at once is bounded by words, whatever the batch; nulls and long rows go through."""
    vocabulary = made_up(7)
    trie, rng, sizes, encode = S.Trie(vocabulary), random.Random(7), [], S._encode
    rows = [rng.choice([None, [], ["ab"] * rng.randrange(30), ["".join(rng.choice("abcdz") for _ in range(4)) for _ in range(rng.randrange(9))]]) for _ in range(200)]
    column = pa.array(rows, pa.list_(pa.string()))
    expected = encode(trie, column).to_pylist()
    monkeypatch.setattr(S, "SLICE", 16)
    monkeypatch.setattr(S, "_encode", lambda t, c: sizes.append((len(c), sum(len(r or []) for r in c.to_pylist()))) or encode(t, c))
    assert S._sliced(trie, column).to_pylist() == S._sliced(trie, pa.chunked_array([column.slice(0, 70), column.slice(70)])).to_pylist() == expected
    assert S._sliced(trie, column.slice(50, 60)).to_pylist() == expected[50:110] and S._sliced(trie, column.slice(0, 0)).to_pylist() == []
    assert all(n == 1 or words <= 16 for n, words in sizes) and len(sizes) > 40


def test_cache_writes_a_file_for_a_bucket(spark, tmp_path):
    """The files do not grow with the tasks, and what made the texts is run once for all their uses."""
    folder, runs = f"{tmp_path}/cache", spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = spark.range(400).selectExpr("id", "concat('ab ', id % 200) AS text").repartition(7).mapInArrow(seen, "id long, text string")
    assert S.cached_lengths(df, f"file://{folder}", S.encoder(spark, made_up(8))).count() == 400
    buckets = list((tmp_path / "cache").glob("_bucket=*"))
    assert len(list((tmp_path / "cache").rglob("*.parquet"))) == len(buckets) > 40 and runs.value == 400
