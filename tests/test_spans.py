"""Span algebra, projection, samples and batches against loops over characters, pairs and rows, and plans."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import features, grid, metrics, projection, sequences, spans, splitting

FACTS, ISSUE, PLAINTIFF, LAW, ANALYSIS = 1, 2, 3, 5, 6


def rows(spark, items, text_letter=True):
    data = [("x", b, e, label, "rhetorical", text_letter) for b, e, label in items]
    return spark.createDataFrame(data, "case_id string, b long, e long, label long, kind string, letter boolean")


def drawn(seed, n=40, far=60):
    """Random spans of a few documents, with bounds that often agree."""
    rng, out = random.Random(seed), []
    for case in "pqrs":
        for _ in range(rng.randint(n // 2, n)):
            b = rng.randrange(0, far, rng.choice([1, 10]))
            out.append((case, b, b + rng.choice([5, 9, 20, 31, 45]), rng.randrange(9)))
    return out


def spans_of(spark, items):
    return spark.createDataFrame([(c, b, e, label, "rhetorical", True) for c, b, e, label in items], "case_id string, b long, e long, label long, kind string, letter boolean")


def collapsed(items):
    """(case, place) of each distinct pair of bounds, in order, with its roles."""
    out = {}
    for case in {x[0] for x in items}:
        for k, (b, e) in enumerate(sorted({x[1:3] for x in items if x[0] == case})):
            out[case, k] = (b, e, {x[3] for x in items if x[:3] == (case, b, e)})
    return out


def test_regions_gather_all_roles_of_the_same_bounds(spark):
    items = drawn(11)
    got = {(r.case_id, r.region_idx): (r.b, r.e, {k for k in range(9) if r["mask"] >> k & 1}) for r in spans.regions(spans_of(spark, items)).collect()}
    assert got == collapsed(items) and any(len(v[2]) > 1 for v in got.values())


def test_pairs_of_regions_by_their_characters(spark):
    """Nested: the characters of one are a part of the other's. Crossing: some are shared, and each has some before or after."""
    items = drawn(12, 25)
    held = collapsed(items)
    inside, same, across = set(), set(), set()
    for (c, i), (b, e, own) in held.items():
        for (d, j), (f, g, other) in held.items():
            if c != d or i == j:
                continue
            x, y = set(range(b, e)), set(range(f, g))
            if y < x:
                inside.add((c, i, j))
                if own & other:
                    same.add((c, i, j))
            elif i < j and x & y and x - y and y - x:
                across.add((c, i, j))
    found = spans.regions(spans_of(spark, items))
    nested = spans.nesting(found).collect()
    assert {(r.case_id, r.i, r.j) for r in nested} == inside and {(r.case_id, r.i, r.j) for r in nested if r.same_role} == same and same
    assert {(r.case_id, r.i, r.j) for r in spans.crossing(found).collect()} == across and across


def test_touching_spans_do_not_cross(spark):
    found = spans.regions(rows(spark, [(0, 10, 0), (10, 20, 1), (0, 5, 2)]))
    assert spans.crossing(found).count() == 0


def test_rows_nearly_as_another_go(spark):
    """A row goes if one of its case and role holds it, with other bounds, and is at most twenty characters longer; the first such, the longest of equals, is logged."""
    items = drawn(13)
    log = {}
    for c, b, e, label in set(items):
        holders = [(f, -g) for d, f, g, other in items if (d, other) == (c, label) and f <= b and e <= g and (f, g) != (b, e) and (g - f) - (e - b) <= spans.NEAR]
        if holders:
            f, g = min(holders)
            log[c, label, b, e] = (f, -g)
    made = spans_of(spark, items)
    assert {(r.case_id, r.label, r.b, r.e): (r.kept_b, r.kept_e) for r in spans.near_identical(made).collect()} == log and log
    kept = sorted((r.case_id, r.b, r.e, r.label) for r in spans.normalise(made).collect())
    assert kept == sorted(x for x in items if (x[0], x[3], x[1], x[2]) not in log)


def test_tiny_and_letterless_rows_go(spark):
    assert spans.normalise(rows(spark, [(0, 2, 0), (5, 50, 0)])).count() == 1
    assert spans.normalise(rows(spark, [(5, 50, 0)], text_letter=False)).count() == 0


def union(intervals):
    return len({x for b, e in intervals for x in range(b, e)})


def test_union_length_against_sets(spark):
    rng, data, want = random.Random(3), [], {}
    for k in range(200):
        own = [(b, b + rng.randint(1, 20)) for b in (rng.randint(0, 60) for _ in range(rng.randint(1, 6)))]
        data += [(k, b, e) for b, e in own]
        want[k] = union(own)
    got = projection.union_length(spark.createDataFrame(data, "k long, cb long, ce long"), ["k"]).collect()
    assert {r.k: r["cov"] for r in got} == want


def decided(held, b, e):
    """Status, label and kind of the sentence [b, e), by counting each role's characters."""
    hit = [(set(range(max(b, f), min(e, g))), f, g, roles) for f, g, roles in held if min(e, g) > max(b, f)]
    if not hit:
        return ("UNLABELED", None, None)
    size = {r: len(set().union(*(x for x, _, _, roles in hit if r in roles))) for r in range(9)}
    tied = {r for r in size if size[r] == max(size.values())}
    if len(tied) == 1:
        return ("LABELED", tied.pop(), None)
    if any(tied <= roles for *_, roles in hit):
        return ("AMBIGUOUS", None, "co_extensive_multi_role")
    for x, f, g, own in hit:
        for y, h, i, other in hit:
            if tied <= own | other and (f, g) != (h, i) and f <= h and i <= g:
                return ("AMBIGUOUS", None, "nested")
    return ("AMBIGUOUS", None, "other")


def test_projection_by_counting_characters(spark):
    items = drawn(10, 8)
    items += [(c, b, e, (label + 4) % 9) for c, b, e, label in items[::2]]
    cuts = {c: [(k * 7, k * 7 + 7) for k in range(18)] for c in "pqrst"}  # the last has no spans
    grid_ = spark.createDataFrame([(c, k, b, e) for c, own in cuts.items() for k, (b, e) in enumerate(own)], "case_id string, sent_idx long, b long, e long")
    got = {(r.case_id, r.sent_idx): (r.status, r.label, r.ambiguity_kind) for r in projection.project(grid_, spans.regions(spans_of(spark, items))).collect()}
    held = collapsed(items)
    expected = {(c, k): decided([v for (d, _), v in held.items() if d == c], b, e) for c, own in cuts.items() for k, (b, e) in enumerate(own)}
    assert got == expected and {v[0] for v in expected.values()} == {"UNLABELED", "LABELED", "AMBIGUOUS"} and {v[2] for v in expected.values()} == {None, "co_extensive_multi_role", "nested", "other"}


def cut(spark, text):
    docs = spark.createDataFrame([("x", text)], "case_id string, text string")
    return [text[r.b : r.e] for r in grid.sentences(docs).orderBy("sent_idx").collect()]


def test_sentences(spark):
    assert cut(spark, "One two. Three? Four!\r\n\r\nFive") == ["One two.", "Three?", "Four!", "Five"]
    assert cut(spark, "On 12/3/2023 it was 3.5 m.") == ["On 12/3/2023 it was 3.5 m."]
    assert cut(spark, " ... \n\n 😀 a. ") == ["😀 a."]
    assert cut(spark, "سؤال؟ جواب.") == ["سؤال؟", "جواب."]


def test_decoding(spark):
    df = spark.createDataFrame([([0, 0, 700, 810] + [0] * 5,), ([110, 0, 0, 0, 140] + [0] * 4,), ([0, 40, 40] + [0] * 6,)], "p array<long>")
    assert [r.m for r in df.select(metrics.decode(F.col("p"), F.lit(500)).alias("m")).collect()] == [12, 16, 2]


def test_scores(spark):
    df = spark.createDataFrame([(1 << LAW, 1 << LAW), (1 << ISSUE | 1 << ANALYSIS | 1 << FACTS, 1 << ISSUE), (1 << FACTS, 1 << LAW), (1 << ISSUE, 1 << ISSUE)], "gold long, pred long")
    assert [round(r.set_f1, 6) for r in metrics.per_example(df).collect()] == [1.0, 0.5, 0.0, 1.0]
    got = metrics.summary(df, []).head()
    assert got.macro_f1 == round((2 / 3 + 1) / 9, 6) and got.micro_f1 == round(6 / 10, 6)


def test_runs(spark):
    df = spark.createDataFrame([("a", i) for i in (2, 3, 4, 7)] + [("b", 1), ("b", 2), ("b", 9)], "case_id string, sent_idx long")
    got = {(r.case_id, r.first, r.last) for r in sequences.run_bounds(df, "case_id", "sent_idx").collect()}
    assert got == {("a", 2, 4), ("a", 7, 7), ("b", 1, 2), ("b", 9, 9)}


def test_windows(spark):
    def plain(n):
        out, at = [], 0
        while True:
            out.append((at, min(n, at + 510)))
            if at + 510 >= n:
                return out
            at += 382

    df = spark.range(1, 2500).select("id", sequences.windows(F.col("id")).alias("w"))
    assert all([(x["first"], x["last"]) for x in r.w] == plain(r.id) for r in df.collect())


def test_terciles(spark):
    df = spark.createDataFrame([(x,) for x in (50, 31, 12, 12, 77, 20, 8, 45)], "n_regions long")
    assert tuple(splitting.volume_bounds(df).head()) == (12, 45)


def test_split_keeps_groups_and_sizes():
    rng = random.Random(1)
    flags = {i: {"a": rng.random() < 0.5, "b": rng.random() < 0.2} for i in range(100)}
    groups = [[0, 1, 2], *([i] for i in range(3, 100))]
    sizes = {"train": 70, "val": 15, "test": 15}
    one = splitting.stratified_group_split(flags, groups, sizes, 5)
    assert one == splitting.stratified_group_split(flags, groups, sizes, 5) != splitting.stratified_group_split(flags, groups, sizes, 6)
    assert len({one[0], one[1], one[2]}) == 1
    assert {s: list(one.values()).count(s) for s in sizes} == sizes
    for name in ("a", "b"):
        total = sum(f[name] for f in flags.values())
        assert all(abs(sum(flags[i][name] for i in one if one[i] == s) - total * k / 100) <= 2 for s, k in sizes.items())


def test_split_without_room_is_an_error():
    flags = {i: {"a": 1} for i in range(4)}
    for groups, sizes in (([[0, 1, 2], [3]], {"x": 2, "y": 2}), ([[0], [1], [2]], {"x": 4}), ([[0], [1], [2], [3]], {"x": 3})):
        try:
            splitting.stratified_group_split(flags, groups, sizes, 1)
        except ValueError:
            continue
        raise AssertionError(groups)
    assert splitting.stratified_group_split({}, [], {"x": 0}, 1) == {}


def greedy(rows, n, cap):
    """One row at a time, level by level."""
    key = lambda r: (hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest(), r[0], r[1])
    out = []
    for level, (most_doc, most_role) in enumerate(((2, cap), (3, cap + 2), (10**9, 10**9)), 1):
        for r in sorted(rows, key=key):
            if len(out) < n and r not in [x[:3] for x in out] and sum(x[0] == r[0] for x in out) < most_doc and sum(x[2] == r[2] for x in out) < most_role:
                out.append((*r, level))
    return out


@pytest.mark.parametrize("seed,n,cap,documents,roles,size", [(1, 8, 2, 40, 4, 400), (2, 20, 2, 40, 4, 400), (3, 60, 3, 9, 7, 150), (4, 25, 5, 3, 2, 30), (5, 500, 2, 12, 3, 90)])
def test_capped_sample_is_the_greedy_one(spark, monkeypatch, tmp_path, seed, n, cap, documents, roles, size):
    monkeypatch.setattr(splitting, "PASS", 17)
    rng = random.Random(seed)
    rows = [(rng.randrange(documents), i, min(rng.randrange(roles), rng.randrange(roles))) for i in range(size)]
    df = spark.createDataFrame(rows, "case_id long, k long, role long")
    got = [tuple(r) for r in splitting.capped_sample(df, n, "role", cap, f"file://{tmp_path}", "case_id", "k").collect()]
    assert got == greedy(rows, n, cap) and len(got) == min(n, size)


def test_capped_sample_counts_only_what_it_took(spark, tmp_path):
    """A document's third row of a role that is full does not use the document up: its first row of another role is of level 1."""
    rows = sorted(((1, k, 0) for k in range(3)), key=lambda r: hashlib.md5(f"1:{r[1]}".encode()).hexdigest())
    last = next(k for k in range(3, 1000) if hashlib.md5(f"1:{k}".encode()).hexdigest() > hashlib.md5(f"1:{rows[-1][1]}".encode()).hexdigest())
    df = spark.createDataFrame([*rows, (1, last, 1)], "case_id long, k long, role long")
    got = splitting.capped_sample(df, 2, "role", 1, f"file://{tmp_path}", "case_id", "k").collect()
    assert [(r.k, r.role, r.level) for r in got] == [(rows[0][1], 0, 1), (last, 1, 1)]
    assert splitting.capped_sample(df.limit(0), 5, "role", 2, f"file://{tmp_path}", "case_id", "k").count() == 0


@pytest.mark.parametrize("capacity,most,segment", [(12, 4, 5), (12, 4, 1 << 16), (3, 7, 8), (0, 3, 4), (100, 1, 2)])
def test_batches_are_those_of_one_pass(spark, tmp_path, capacity, most, segment):
    rng = random.Random(capacity + most)
    rows = [(f"c{i % 9}", i, rng.choice([0, 1, 2, 5, 13])) for i in range(120)]
    expected, batch, weight, n = {}, 0, 0, 0
    for c, i, w in sorted(rows):
        if n and (weight + w > capacity or n >= most):
            batch, weight, n = batch + 1, 0, 0
        weight, n = weight + w, n + 1
        expected[c, i] = batch
    df = spark.createDataFrame(rows, "case_id string, k long, w long")
    got = {(r.case_id, r.k): r.batch for r in sequences.batches(df, ["case_id", "k"], "w", capacity, most, f"file://{tmp_path}", segment).collect()}
    assert got == expected


def test_no_batches_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "k long, w long")
    assert sequences.batches(df, ["k"], "w", 5, 3, f"file://{tmp_path}").count() == 0


def test_lexical_features_by_hand(spark):
    given = [("وقال القاضي: «لا» 12", 9, 10), ("x", 0, 1), ("...", 3, 4), ("a b² (c) d e f g h i j k", 5, 11)]
    df = spark.createDataFrame(given, "t string, k long, n long")
    one, two, three, four = ({x.f: x.v for x in r.f} for r in df.select(features.lexical(F.col("t"), F.col("k"), F.col("n")).alias("f")).collect())
    assert one == {"bias": "1", "n_tok": "<5", "n_char": "<40", "has_digit": "1", "has_colon": "1", "has_paren": "0", "has_quote": "1", "decile": "9", "first": "وقال", "last": "12", "pre3": "وقا", "first2": "وقال_القاضي", "waw_start": "1", "w=وقال": "1", "w=القاضي": "1", "w=لا": "1", "w=12": "1"}
    assert two["first"] == two["last"] == "x" and "first2" not in two and two["waw_start"] == "0" and two["decile"] == "0"
    assert three == {"bias": "1", "n_tok": "<5", "n_char": "<40", "has_digit": "0", "has_colon": "0", "has_paren": "0", "has_quote": "0", "decile": "7"}
    assert four["n_tok"] == "<20" and four["has_digit"] == "1" and four["has_paren"] == "1" and four["has_quote"] == "0"
    sizes = spark.createDataFrame([("w " * k,) for k in (4, 5, 39, 40, 79, 80, 160)], "t string")
    got = [({x.f: x.v for x in r.f}["n_tok"], {x.f: x.v for x in r.f}["n_char"]) for r in sizes.select(features.lexical(F.col("t"), F.lit(0), F.lit(1)).alias("f")).collect()]
    assert got == [("<5", "<40"), ("<10", "<40"), ("<40", "<80"), ("<80", "<160"), ("<80", "<160"), (">=80", "<320"), (">=80", "<640")]


def test_robustness_of_two_grids(spark):
    rows_ = [("v1", "train", "a", "LABELED", None, 0, 4), ("v1", "train", "a", "AMBIGUOUS", "nested", 4, 10), ("lines", "train", "a", "LABELED", None, 0, 4), ("lines", "train", "a", "LABELED", None, 4, 10)]
    rows_ += [("v1", "val", "b", "UNLABELED", None, 0, 8), ("lines", "val", "b", "UNLABELED", None, 0, 8), ("v1", "val", "c", "LABELED", None, 0, 1), ("lines", "val", "c", "AMBIGUOUS", "other", 0, 1)]
    df = spark.createDataFrame(rows_, "grid string, split string, case_id string, status string, ambiguity_kind string, b long, e long")
    got = {(r.grid, r.split): r for r in projection.robustness(df).collect()}
    assert len(got) == 6 and all(r.adds_up for r in got.values())
    r = got["v1", "all"]
    assert (r.n, r.n_docs, r.unlabeled, r.ambiguous, r.eligible, r.covered, r.nested, r.other, r.median_length) == (4, 3, 1, 1, 2, 3, 1, 0, 5.0)
    moved = [(r.case_id, r.split, r.first_rate, r.second_rate, r.delta, r.first_n, r.second_n) for r in projection.moved(df, "v1", "lines").collect()]
    assert moved == [("c", "val", 0.0, 100.0, 100.0, 1, 1), ("a", "train", 50.0, 0.0, -50.0, 2, 2)]


def test_interval_joins_are_equi_joins(spark):
    found = spans.regions(rows(spark, [(0, 100, FACTS), (10, 20, LAW)]))
    plan = spans.nesting(found)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_shingles_and_escape(spark):
    df = spark.createDataFrame([("a b  c\nd",), ("a b",), ("",)], "t string")
    assert [r.s for r in df.select(T.shingles(F.col("t"), 3).alias("s")).collect()] == [["a b c", "b c d"], ["a b"], [""]]
    assert df.limit(1).select(T.html_escape(F.lit("<a&\n'")).alias("s")).head().s == "&lt;a&amp;<br>&#x27;"


def test_sentence_texts_are_cut_without_a_shuffle(spark):
    """Texts of sentences are those at the grid's offsets, also where a text has the mark that cuts; a text is met by no join."""
    given = [(1, "One two. \u00a0Three?\u3000\n \nfour 5!  ... x"), (2, "..."), (3, "a\x01 b. c\x01d. e"), (4, "x." * 3 + " y")]
    docs = spark.createDataFrame(given, "case_id long, text string")
    by_offsets = grid.sentences(docs).join(docs, "case_id").select("case_id", "sent_idx", T.slice_(F.col("text"), F.col("b"), F.col("e")).alias("text"))
    got = {(r.case_id, r.sent_idx): (r.text, r.grid_n) for r in grid.texts(docs).collect()}
    expected = {(r.case_id, r.sent_idx): r.text for r in by_offsets.collect()}
    assert {k: t for k, (t, _) in got.items()} == expected and [t for (c, _), (t, _) in sorted(got.items()) if c == 1] == ["One two.", "Three?", "four 5!", "x"]
    assert all(n == sum(c == k for k, _ in expected) for (c, _), (_, n) in got.items())
    plan = grid.texts(docs.filter("case_id <> 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].startswith("Union") and "Join" not in plan.split(":  +-")[0].split("+- ")[0]


def test_digits_as_ranges(spark):
    """The class of ranges has the same characters, of which all are numbers."""
    points = [c for c in range(0x110000) if chr(c).isdigit()] + list(range(0x2000)) + [0x2473, 0x247D, 0x2776 - 1, 0x1F10B]
    df = spark.createDataFrame([(chr(c),) for c in points if not 0xD800 <= c < 0xE000], "t string")
    assert len(features.DIGITS) < len(features.DIGIT) * 8 and df.filter(F.col("t").rlike(features.DIGITS) != F.col("t").rlike(features.DIGIT)).count() == 0
    assert df.filter(F.col("t").rlike(features.DIGIT) & ~F.col("t").rlike(r"\p{N}")).count() == 0


def test_white_space_is_that_of_the_pattern(spark):
    df = spark.createDataFrame([(c, chr(c)) for c in (*range(0x3100), 0xFEFF) if not 0xD800 <= c < 0xE000], "c int, t string")
    assert {r.c for r in df.filter(F.col("t").rlike(r"^(?U:\s)$")).collect()} | set(map(ord, "\n\r\x85\u2028\u2029")) == set(map(ord, T.WHITE))
    one = df.filter(F.length("t") > 0).select("c", T.leading(F.concat("t", F.lit("a"))).alias("n"), T.trimmed_length(F.concat(F.lit("a"), "t")).alias("m"))
    assert all((r.n == 1) == (chr(r.c) in T.WHITE) == (r.m == 1) for r in one.collect())
