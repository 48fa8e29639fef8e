"""Hard negatives, bottom-k near-duplicates and spelling variants against brute force, with empty, null, long, tied and repeated rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hard_negatives, jaccard_join, minhash, spelling
from spanloom.llm import textnum as tn

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Hard negatives


def mined(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """rows: (id, label, vector, anchor), clean and of distinct ids."""
    whole = {i: [int(np.floor(scale * x)) for x in v] for i, _, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    out = []
    for a, label, _, anchor in rows:
        if not anchor:
            continue
        best = sorted((-dot(a, i), i) for i, own, _, _ in rows if own == label and i != a)[:positives]
        for s, p in best:
            inside = sorted((-dot(a, i), i) for i, own, _, _ in rows if own != label and low * -s <= 100 * dot(a, i) <= high * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


def vectors(n, seed, width=6, top=1.0):
    rng = random.Random(seed)
    hot = [rng.uniform(0, top) for _ in range(width)]
    out = []
    for i in range(n):
        v = hot if rng.random() < 0.3 else [rng.choice([0.25, 0.5, rng.uniform(-0.2, 1)]) * top for _ in range(width - i % 2)]
        out.append((i * 3 - 40, 0 if rng.random() < 0.4 else rng.randint(1, 3), v, i % 7 == 0))
    return out


SCHEMA = "vec_id long, label int, embedding array<double>, pick boolean, id int, score int"


@pytest.mark.parametrize("block", [1 << 23, 200])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows = vectors(150, 3) + [(1000, 1, [], True), (1001, 9, [0.5] * 6, True)]
    odd = [(None, 1, [1.0] * 6, True), (2000, None, [1.0] * 6, True), (2001, 1, None, True), (2002, 1, [1.0, None], False), (2003, 1, [float("nan")], False), (2004, 1, [float("inf")] * 6, False), (2005, 1, [1.0, float("-inf")], False)]
    again = [r for r in rows[::5]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd + again], SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("pick")).collect())
    assert got == mined(rows) and len(got) > 50
    assert hard_negatives.mine(df.limit(0), F.col("pick")).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_one_id_are_one_row(spark):
    rows = [(0, 1, [1.0], True), (5, 1, [0.5], False), (7, 2, [0.3], False)]
    more = [(7, 2, [0.4], False), (7, 3, [0.1], False)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + more], SCHEMA)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("pick")).collect()) == mined(rows) == [(0, 5, 1, 7, 256 * 128, 256 * 76)]


def test_hard_negatives_with_scores_beyond_doubles(spark):
    rows = vectors(60, 5, top=float(1 << 18))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("pick")).collect())
    assert got == mined(rows) and max(r[4] for r in got) > 1 << 53
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(1, 1, [1e9] * 4, True, 1, 2)], SCHEMA), F.col("pick"))


def test_best_lists_merge():
    rng = np.random.default_rng(1)
    best, seen = hard_negatives.Best(4, 3, np.full(4, -100)), defaultdict(list)
    for ident in range(300):
        score = rng.integers(0, 12, 4)
        rows = np.flatnonzero(score > best.least)
        for r in range(4):
            seen[r].append((-int(score[r]), ident))
        best.add(rows, score[rows], np.full(len(rows), ident))
    for r in range(4):
        own = best.row == r
        assert sorted(zip((-best.score[own]).tolist(), best.id[own].tolist(), strict=True)) == sorted(seen[r])[:3]


# Bottom-k sketches


def shingle_sets(given, n):
    out = {}
    for i, t in given.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def classes_of(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                inter = len(sets[x] & sets[y])
                if 100 * inter >= percent * (len(sets[x]) + len(sets[y]) - inter):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: find(i) for i in ids}


def near_texts(seed=2, long=False):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    out = [None, "", "   ", "one", "One", "one two", "one\ttwo three"]
    shared = " ".join(word() for _ in range(60))
    for _ in range(14):
        base = [word() for _ in range(rng.choice([6, 12, 30, 120, 400] + [2000] * long))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy) + (f" {shared}" if rng.random() < 0.4 else ""))
    base = [word() for _ in range(150)]
    for k in range(40):  # a hot group in which each differs from the last
        base[k * 3] = f"x{k}"
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("k,percent,sets", [(128, 80, 256), (128, 85, 8), (32, 80, 8)])
def test_minhash_components(spark, monkeypatch, k, percent, sets):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 1 << 18 if sets == 256 else 4096)
    given = dict(enumerate(near_texts(seed=percent + k, long=k == 128), start=10))
    expected_sets = shingle_sets(given, 4)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in given.items()], "doc_id long, text string, mark int, sketch string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, n=4, percent=percent, k=k).collect()}
    reach = classes_of(expected_sets, percent)
    assert got == {i: (len(expected_sets[i]), reach[i]) for i in given}
    assert len(set(reach.values())) < len(reach) - 20


def test_minhash_repeated_and_missing_ids(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "red green blue white black grey"
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (3, a), (3, b), (None, a), (4, c), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, n=4).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 2, 1), (3, 3, 1), (3, 2, 1), (None, 3, None), (4, 3, 4), (5, 0, 5)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_union_sketches():
    """Counts of the inverted lists against sets, and no pair that links is turned away."""
    rng, k = random.Random(6), 64
    m = minhash.least_shared(128, 80)
    assert m == 64 and minhash.least_shared(k, 80) < 32
    base = [rng.getrandbits(64) for _ in range(500)]
    sets = []
    for _ in range(60):
        size = rng.choice([1, 3, 40, 60, 64, 70, 200, 500])
        own = set(base[:size])
        for _ in range(rng.choice([0, size // 12, size // 3])):
            own.discard(rng.choice(base))
            own.add(rng.getrandbits(64))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    made = [minhash.bottom(s, k) for s in sets]
    lists = minhash.Inverted(made, k)
    linked = defaultdict(set)
    for i, s in enumerate(sets):
        shared, inside = lists.row(i)
        for j, t in enumerate(sets):
            a, b = set(made[i].tolist()), set(made[j].tolist())
            assert shared[j] == len(a & b) and inside[j] == len(set(sorted(a | b)[:k]) & a & b)
            inter = len(set(s.tolist()) & set(t.tolist()))
            if i < j and 100 * inter >= 80 * (len(s) + len(t) - inter):
                linked[i].add(j)
    found = minhash.estimate_block(made, None, k, 80)
    root = list(range(len(sets)))
    for i, j in found:
        old, new = root[j], root[i]
        root = [new if r == old else r for r in root]
    assert linked and all(root[i] == root[j] for i in linked for j in linked[i])
    halves = minhash.estimate_block(made[:30], made[30:], k, 80)
    assert halves and all(0 <= i < 30 and 0 <= j < 30 for i, j in halves)


# Spelling variants


def distance_one(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if abs(len(x) - len(y)) != 1:
        return False
    a, b = sorted((x, y), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def word_counts(rows, length, drop):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                out[run] += 1
    return out


def spelled(counts, times):
    near = {w: [v for v in counts if distance_one(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def misspelt(seed=4, n=400):
    rng = random.Random(seed)
    letters = "abÀéÿ"
    stems = ["".join(rng.choice(letters + "xyz") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(12)] + ["aaaaaaaa", "abababab", "b" * 40 + "a" * 40]
    rows = []
    for i in range(n):
        out = []
        for _ in range(12):
            w = list(rng.choice(stems[: 1 + i % len(stems)]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(letters)], [rng.choice("AB")]])
            out.append("".join(w) + rng.choice([" ", "1", "中", "×÷", "\n", "Ā"]))
        rows.append((None if i % 50 == 0 else i, "".join(out)))
    return rows + [(1, None), (2, ""), (3, "short"), *rows[:3]]


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_spelling_variants(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    rows = misspelt()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    counts = word_counts(rows, 7, 31)
    assert {r.word: r.n for r in spelling.words(df, 7, 31).collect()} == counts
    assert {r.word: r.n for r in spelling.words(df, 3).collect()} == word_counts(rows, 3, None)
    often = {w: n for w, n in counts.items() if n >= 2}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, times=3, drop=31).collect()}
    expected = spelled(often, 3)
    assert got == expected and sum(v[0] != v[1] for v in expected.values()) > 0
    assert spelling.variants(df.limit(0)).count() == 0


def test_words_of_long_texts(monkeypatch):
    """Windows end between words, and checksums of long runs agree with those taken side by side."""
    monkeypatch.setattr(tn, "CHUNK_BYTES", 64)
    rng = random.Random(8)
    text = "".join(rng.choice(["é", "a", "B", "ÿÀ", " ", "中文", "ā", "1"]) for _ in range(4000)) + "x" * 500 + " " + "中" * 300 + "é" * 200
    for given in ([text], ["a b", text, None, text[:300]]):
        total = Counter()
        for batch in spelling._count(pa.array(given), [str(i) for i in range(len(given))], 3, 5):
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[w] += n
        assert total == word_counts(list(enumerate(given)), 3, 5)


def test_near_against_all_cuts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    for x in made:
        for y in made:
            assert spelling.near(x, y) == distance_one(x, y)
    whole = sorted(set(made))
    for sides in (0, 1):
        shard = spelling.Shard(whole, list(range(len(whole))), [sides] * len(whole))
        found = shard.scan(whole, [sides] * len(whole))
        assert found is None or set(found.column("word").to_pylist()) <= set(whole)


def test_very_long_words(spark):
    a, b = "ab" * 20_000, "ab" * 10_000 + "x" + "ab" * 10_000
    df = spark.createDataFrame([(1, f"{a} {b} {a}"), (2, f"{b} {a} {a}")], "doc_id long, text string")
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(df, times=2).collect()}
    assert got == {a: (None, 1), b: (a, 1)}


@pytest.mark.parametrize("find", [minhash.near_duplicates, jaccard_join.join])
def test_last_round_moves_sets_by_open_pairs(spark, monkeypatch, find):
    """A large cluster whose sets share much, but link with few, sends sets to the last round only where parities leave a link open."""
    rng, given = random.Random(4), []
    word = lambda: f"w{rng.getrandbits(40)}"
    parts = [" ".join(word() for _ in range(40)) for _ in range(90)]
    for k in range(90):  # each shares half of itself with the next one
        given.append(f"{parts[k]} {parts[(k + 1) % 90]}")
    given += [f"{given[7]} more", f"{given[40]} {word()}"]
    for name, value in (("LIST", 2), ("BLOCK_SHINGLES", 4096), ("BLOCK_SETS", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    sent, between = [], jaccard_join._link_between
    monkeypatch.setattr(jaccard_join, "_link_between", lambda pairs, link: (sent.append(pairs.count()), between(pairs, link))[1])
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in find(df, n=4, percent=80).collect()}
    assert got == classes_of(shingle_sets(dict(enumerate(given)), 4), 80)
    assert len(sent) < 2 or max(sent[1::2]) < len(given)


def test_parities_bound_overlaps():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(3000)]
    sets = [np.unique(np.array(rng.sample(base, rng.choice([1, 30, 400, 2000])), dtype=np.uint64)) for _ in range(40)]
    bits, size = np.array([jaccard_join.parities(x) for x in sets]), np.array([len(x) for x in sets])
    need = lambda x, y: jaccard_join.least_overlap(x + y, 30)
    may = jaccard_join.possible(bits, size, bits, size, need)
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert may[shared >= need(size[:, None], size)].all() and not may.all()
