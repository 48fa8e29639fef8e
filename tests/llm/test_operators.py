"""Operators against brute force, with empty, null, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, common, components, decontaminate, html_extract, jaccard_join, kd_shards, language_id, line_dedup, media, queries, token_store, toxicity
from spanloom.llm import textnum as tn

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["'s", "'re", "'", "''", "s", "r", "e", " ", "  ", "\n", "\t", "1", "²", "é", "中", "!", "😀", "　", "\r\n", "Word", "_"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    return [None, "", "a" * 3000, "'" * 700, " " * 50, *("".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def frame(spark, items, start=0):
    """Documents with an extra column of a clashing name."""
    rows = [(start + i, t, i) for i, t in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def tiktoken_reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_round_trip(spark):
    reference, given = tiktoken_reference(), texts()
    docs = frame(spark, given)
    for made in (bpe.decode(bpe.encode(docs, RANKS), RANKS), bpe.encode_decode(docs, RANKS)):
        rows = made.collect()
        assert len(rows) == len(given)
        for r in rows:
            t = given[r.doc_id] or ""
            assert list(r.ids) == reference.encode_ordinary(t) and bytes(r.bytes) == t.encode()
            starts = np.cumsum([0, *(len(reference.decode_single_token_bytes(i)) for i in r.ids)])[:-1]
            assert list(r.offsets) == starts.tolist()
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_bpe_classes_cover_all_characters():
    reference, encoder = tiktoken_reference(), bpe._encoder(RANKS, bpe.class_table())
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}1{chr(c)}'s " for c in points)
    raw, off = tn.utf8(__import__("pyarrow").array([text]))
    assert encoder.encode(raw, off)[0].tolist() == reference.encode_ordinary(text)


def arrow(*given):
    return tn.utf8(__import__("pyarrow").array(given, __import__("pyarrow").string()))


@pytest.mark.parametrize("alphabet", [[*BITS, "some longer words "], ["中", "文", "é", "ー", "ไ", "'", "s", "a" * 40], ["a", "b"], [" ", "\n"]])
def test_bpe_windows_of_long_texts(monkeypatch, alphabet):
    monkeypatch.setattr(tn, "CHUNK_BYTES", 64)
    reference, encoder = tiktoken_reference(), bpe._encoder(RANKS, bpe.class_table())
    rng = random.Random(4)
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    ids, where, cut = encoder.encode(*arrow(text))
    assert ids.tolist() == reference.encode_ordinary(text) and cut.tolist() == [0, len(ids)]
    assert where.tolist() == np.cumsum([0, *(len(reference.decode_single_token_bytes(i)) for i in ids)])[:-1].tolist()


def test_bpe_merges_agree():
    """Side by side, all of a rank at once, and pair by pair."""
    own, rng = bpe._vocabulary(RANKS), random.Random(14)
    made = [bytes(rng.choice(b"abrehtinso\xc3\xa9") for _ in range(rng.randint(2, 200))) for _ in range(300)] + [b"a" * k for k in range(1, 40)]
    flat, size = np.frombuffer(b"".join(made), dtype=np.uint8), np.array(list(map(len, made)))
    ids, count = own.merge(flat, np.cumsum(size) - size, size)
    for piece, got in zip(made, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert got.tolist() == bpe.merge(piece, own.ranks) == own.merge_long(np.frombuffer(piece, dtype=np.uint8)).tolist()


def test_bpe_merges_that_make_a_lower_rank():
    """A vocabulary in which joining opens a pair of lower rank, which goes first."""
    tokens = [bytes([i]) for i in range(256)] + [b"cab", b"aba", b"ab", b"ca", b"abab"]
    own = bpe.Vocabulary({t: i for i, t in enumerate(tokens)})
    for piece in (b"cabab", b"ababab", b"abcabab", b"abababab"):
        raw = np.frombuffer(piece, dtype=np.uint8)
        assert own.merge(raw, np.array([0]), np.array([len(piece)]))[0].tolist() == bpe.merge(piece, own.ranks) == own.merge_long(raw).tolist()


def test_piece_cache_forgets(monkeypatch):
    table, reference, encoder = bpe.class_table(), tiktoken_reference(), bpe._encoder.__wrapped__(RANKS, bpe.class_table())
    monkeypatch.setattr(bpe, "CACHE_BYTES", encoder.pieces.size + 500)
    most = 0
    for t in texts(60, seed=9)[5:]:
        assert encoder.encode(*arrow(t))[0].tolist() == reference.encode_ordinary(t)
        most = max(most, encoder.pieces.size)
    assert encoder.pieces.fixed <= encoder.pieces.n and most < bpe.CACHE_BYTES + 20_000 and table


def test_bpe_of_repeated_rows_and_clashing_names(spark):
    rows = [(7, "same text", 1, "x"), (7, "same text", 1, "x"), (None, "no id", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes int, offsets string")
    got = bpe.encode_decode(docs, RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in got) == [(0, b"no id"), (7, b"same text"), (7, b"same text")]
    assert bpe.encode_decode(docs.limit(0), RANKS).count() == 0


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    special = "<|endoftext|>"
    given = [*texts(), special, f"a {special}{special} 's{special}", "<|endof", "text|>", "x" * 900 + " y", "dup", "dup"]
    rows = [(i * 3 - 50, t) for i, t in enumerate(given)]
    rows[-1] = rows[-2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (tmp_path / "store").mkdir()
    manifest = common.Scratch(spark, "test").table(token_store.write(docs, path, f"file://{tmp_path}/store", shards=5), "manifest")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, manifest).collect())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    found = token_store.lookup(manifest, [-50, rows[-1][0], 10**9, -49])
    assert [x.tolist() for x in found[-50]] == [[0]] and len(found[rows[-1][0]]) == 2 and found[10**9] == found[-49] == []
    for i, t in rows[:40]:
        assert found.update(token_store.lookup(manifest, [i])) is None and found[i][0].tolist() == [*reference.encode(t or "", add_special_tokens=False).ids, 0]


def test_token_store_of_odd_rows(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    schema = "doc_id long, text string, shard int, row string"
    odd = [(None, "a b", 1, "x"), (None, None, 2, "y"), *[(5, "same", 3, "z")] * 60, (5, "other", 4, "w")]
    for name, rows in (("odd", odd), ("none", [])):
        (tmp_path / name).mkdir()
        manifest = common.Scratch(spark, "test").table(token_store.write(spark.createDataFrame(rows, schema), path, f"file://{tmp_path}/{name}", shards=4), "manifest")
        got = sorted(token_store.read(spark, manifest).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][: len(got)]
        assert len(token_store.lookup(manifest, [5])[5]) == (61 if rows else 0)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    own = token_store._slot_keys(keys)
    index = token_store.PerfectHash.build(own)
    assert sorted(index.slots(own)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([7, 7], dtype=np.uint64))


def test_media(spark):
    given = [*texts(60), "x" * 20_000]
    docs = frame(spark, given)
    made = {r.doc_id: r for r in media.features(media.encode(docs)).collect()}
    for i, t in enumerate(given):
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (made[i].n_bytes, made[i].payload_sha256, made[i].tail_crc32) == (len(b), sha(p), zlib.crc32(p[-64:]))
    assert made[0].media_sha256 == made[1].media_sha256 and made[0].feature == made[1].feature


def test_jpeg_decoder_reads_runs_and_long_intervals():
    """A file with another Huffman table, zero runs, an early end, and one interval for all blocks."""
    table = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7) + bytes(range(12))
    ac = bytes([0, 2, 1, 1, 1, 1] + [0] * 10) + bytes([0x01, 0x00, 0xF0, 0xE1, 0x02, 0x12])

    def codes(t):
        out, code, k = {}, 0, 16
        for n in range(1, 17):
            for _ in range(t[n - 1]):
                out[t[k]] = f"{code:0{n}b}"
                code, k = code + 1, k + 1
            code <<= 1
        return out

    d, a = codes(table), codes(ac)
    blocks = [(5, {1: 1, 18: -1}), (5, {63: 1}), (-3, {2: -3})]
    bits, last, want = "", 0, []
    for dc, coefficients in blocks:
        diff, last = dc - last, dc
        n = abs(diff).bit_length()
        bits += d[n] + (f"{diff if diff > 0 else diff + (1 << n) - 1:0{n}b}" if n else "")
        at, row = 1, [dc] + [0] * 63
        for k, v in sorted(coefficients.items()):
            run = k - at
            while run > 15:
                bits, run = bits + a[0xF0], run - 16
            n = abs(v).bit_length()
            bits += a[run << 4 | n] + f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"
            row[k], at = v, k + 1
        if at < 64:
            bits += a[0x00]
        want.append(row)
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    head += media._segment(0xC4, b"\0" + table) + media._segment(0xC4, b"\x10" + ac) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    heads, got = media.read([head + data + b"\xff\xd9"])
    assert got[0][:, 0].tolist() == want
    assert media.thumbnail(heads[0], got[0]).tolist() == [[138, 138, 122]]
    with pytest.raises(ValueError):
        media.parse(b"\xff\xd8" + media._segment(0xC2, b"\0" * 9))


def test_media_features_against_the_payload(spark):
    """Thumbnails and their hashes by plain loops from the payload's bytes, without the decoder; repeated rows, clashing names, an empty table."""
    given = ["", "plain text " * 30, "é" * 700, "x" * 64, "y" * 65, "x" * 64]
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in enumerate(given)] + [(None, None, "b", 6)], "doc_id long, text string, media string, width int")
    rows = media.features(media.encode(docs)).collect()
    assert len(rows) == len(given) + 1
    for r in rows:
        b = (given[r.doc_id] if r.doc_id is not None else "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        n = len(p) // 64
        wide = 1
        while wide * wide < n:
            wide += 1
        high = -(-n // wide)
        level = [min(255, max(0, (v - 128 if v < 128 else v - 127) // 8 + 128)) for v in p[::64]] + [128] * (wide * high - n)
        bits = 0
        for y in range(8):
            line = [level[y * high // 8 * wide + x * wide // 9] for x in range(9)]
            for x in range(8):
                bits = bits << 1 | (line[x] > line[x + 1])
        assert (r.width, r.height, r.feature) == (8 * wide, 8 * high, f"{8 * wide}x{8 * high}:{bits:016x}") and r.thumbnail_hash % (1 << 64) == bits
    same = {(r.media_sha256, r.feature) for r in rows if r.doc_id in (3, 5)}
    assert len(same) == 1 and media.features(media.encode(docs.limit(0))).count() == 0


def test_words_of_long_texts(monkeypatch):
    """Words, their beginnings and shingles are the same whether or not a text is taken in blocks."""
    rng = random.Random(15)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 4, 9, 200]))) for _ in range(400)) + " " + "z" * 3000
    raw, off = arrow(text)
    whole = tn.Words(raw, off, tn.ALNUM, (4, 5))
    monkeypatch.setattr(tn, "CHUNK_BYTES", 300)
    cut = tn.Words(raw, off, tn.ALNUM, (4, 5))
    for a, b in ((whole.hash, cut.hash), (whole.heads, cut.heads), (whole.start, cut.start), (whole.end, cut.end), (whole.shingles(5)[0], cut.shingles(5)[0])):
        assert np.array_equal(a, b)


def test_long_texts_in_joins(spark, monkeypatch):
    monkeypatch.setattr(tn, "CHUNK_BYTES", 200)
    rng = random.Random(16)
    long = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    given = [" ".join(long), " ".join([*long[:2990], *"abcdefghij"]), " ".join(long[:1500]), "short one", None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, given), 4, 85).collect()}
    assert got == dict(enumerate(brute_components(given, 4, 85)))
    items = [(1, " ".join(long[1495:1520]))]
    hits = {r.doc_id: (r.n_words, sum(h["last"] - h["first"] for h in r.hits), list(r["items"])) for r in decontaminate.find(frame(spark, given), spark.createDataFrame(items, "item_id long, text string"), 10).collect()}
    assert hits == brute_hits(given, items, 10)
    assert decontaminate.find(frame(spark, given).limit(0), spark.createDataFrame(items, "item_id long, text string"), 10).count() == 0


def test_link_block_against_all_pairs():
    """Derived answers lose no connection: blocks of near copies, of chains and of unlike sets, within and between."""
    rng = np.random.default_rng(17)
    for kind in range(30):
        base = rng.integers(1, 10**9, 60).astype(np.uint64)
        sets = []
        for _ in range(24):
            x = base.copy()
            x[rng.integers(0, 60, rng.integers(0, 4 + kind))] = rng.integers(1, 10**9, 1)
            sets.append(np.unique(x[: rng.integers(20, 61)] if kind % 3 == 0 else x))
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and len(np.intersect1d(a, b)) > 0

        def parts(pairs, n):
            root = list(range(n))
            for i, j in pairs:
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
            return [root.index(r) for r in root]

        own = jaccard_join.link_block(sets, None, 80)
        assert all(link(sets[i], sets[j]) for i, j in own)
        assert parts(own, 24) == parts([(i, j) for i in range(24) for j in range(i) if link(sets[i], sets[j])], 24)
        made = jaccard_join.link_block(sets[:10], sets[10:], 80)
        assert all(link(sets[i], sets[10 + j]) for i, j in made)
        assert parts([(i, 10 + j) for i, j in made], 24) == parts([(i, j) for i in range(10) for j in range(10, 24) if link(sets[i], sets[j])], 24)


def lines_of(t):
    return (t or "").split("\n")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [" Shared line ", "SHARED LINE", "é É", "É é", "only", "", "  ", "x\x0b", "b", "c"]
    given = [None, "", *("\n".join(rng.choice([*pool, f"own {rng.random()}"]) for _ in range(rng.randint(0, 200 if k == 5 else 6))) for k in range(80))]
    docs = frame(spark, given)
    holders = defaultdict(set)
    for i, t in enumerate(given):
        for line in lines_of(t):
            holders[key_of(line)].add(i)
    for least in (1, 3):
        got = {r.doc_id: r for r in line_dedup.apply(docs, line_dedup.bitmaps(docs, 10, least)).collect()}
        assert len(got) == len(given)
        for i, t in enumerate(given):
            stay = [x for x in lines_of(t) if len(key_of(x)) < least or len(holders[key_of(x)]) < 10]
            assert (got[i]._kept, got[i]._n_lines, got[i]._n_dropped) == ("\n".join(stay), len(lines_of(t)), len(lines_of(t)) - len(stay))
    first, seen = {}, set()
    for i, t in enumerate(given):
        first[i] = []
        for line in lines_of(t):
            k = key_of(line)
            if not k or k not in seen or len(holders[k]) < 10:
                first[i].append(line)
            seen.add(k)
    got = {r.doc_id: r._kept for r in line_dedup.apply(docs, line_dedup.bitmaps(docs, 10, 1, keep_first=True)).collect()}
    assert got == {i: "\n".join(v) for i, v in first.items()}
    assert line_dedup.apply(docs.limit(0), line_dedup.bitmaps(docs.limit(0))).count() == 0


def test_line_dedup_of_repeated_rows_and_long_texts(spark, monkeypatch):
    """Each row is a document; a long text's bitmap leaves whole words out; bitmaps meet the texts by a shuffle too."""
    long = "\n".join("shared" if i in (3, 700, 701, 4095) else f"line {i}" for i in range(5000))
    rows = [(7, "shared\nown", 1)] * 8 + [(None, "Shared ", 2), (8, long, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_ int")
    for limit in (1 << 25, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        maps = line_dedup.bitmaps(docs, 10, 1)
        got = line_dedup.apply(docs, maps).collect()
        assert sorted((r.doc_id or 0, r._n_lines, r._n_dropped) for r in got) == [(0, 1, 1), *[(7, 2, 1)] * 8, (8, 5000, 4)]
        assert [r._kept for r in got if r.doc_id == 8] == ["\n".join(x for x in long.split("\n") if x != "shared")]
        assert [len(r.keep) for r in maps.collect() if r.doc_id == 8] == [3]


def test_line_dedup_is_native(spark):
    docs = frame(spark, ["a\nb"])
    plan = line_dedup.apply(docs, line_dedup.bitmaps(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_components(given, n, percent, pattern=r"[^\x20\x09-\x0D]+"):
    sets = []
    for t in given:
        w = re.findall(pattern, (t or "").translate(FOLD))
        sets.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    root = list(range(len(given)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed=3, groups=12, size=14):
    rng = random.Random(seed)
    out = [None, "", "one", "one", "One two", " \n"]
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 50)}" for _ in range(rng.choice([3, 5, 30, 60, 120]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
            out.append(rng.choice([" ", "  ", "\t"]).join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # force chains, blocks and all rounds
        for name, value in (("LIST", 3), ("BLOCK_SHINGLES", 200), ("BLOCK_SETS", 3), ("BROADCAST_ROWS", 0)):
            monkeypatch.setattr(jaccard_join, name, value)
    given = near_copies()
    rng = random.Random(8)
    base = [f"big{i}" for i in range(60)]
    for _ in range(40):  # a large group, whose members are linked in part
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.random()}"
        given.append(" ".join(w))
    for n, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, given), n, percent).collect()}
        assert got == dict(enumerate(brute_components(given, n, percent)))


def test_jaccard_join_of_hot_lists_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    given = near_copies(seed=5, groups=3, size=40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, given), 4, 85).collect()}
    assert got == dict(enumerate(brute_components(given, 4, 85)))
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "q r s t u"), (9, "q r s t u"), (9, "q r s t u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join(odd, 4, 85).collect()) == [(0, 0), (7, 7), (7, 7), (9, 7), (9, 7)]
    assert jaccard_join.join(odd.limit(0), 4, 85).count() == 0


@pytest.mark.parametrize("block", [1 << 18, 7, 60])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "t").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)} and len(got) == len({r.node for r in got})
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "t"), "t").count() == 0


def brute_hits(given, items, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(FOLD))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(i)
    out = {}
    for d, t in enumerate(given):
        w = word.findall((t or "").translate(FOLD))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if (x := tuple(w[a : a + size])) in windows:
                    found |= windows[x]
                    hit[a : a + size] = [True] * size
        out[d] = (len(w), sum(hit), sorted(str(i) for i in found if i is not None))
    return out


@pytest.mark.parametrize("limit", [1 << 22, 40])
def test_decontaminate(spark, limit):
    rng = random.Random(6)
    vocabulary = [*"abcdefgh", "É1", "x9"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(3, say(14)), (10, say(4)), (2, say(1) + "zz"), (5, None), (6, "..."), (None, "null item words here are six"), (3, say(12))]
    given = [None, "", *(say(rng.randint(0, 40)) for _ in range(60))]
    given += [f"{say(3)}, {(t or '').upper()} - {say(2)}" for _, t in items] + [given[-1], given[-1]]
    given = [None if t is None else t for t in given]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(h["last"] - h["first"] for h in r.hits), list(r["items"])) for r in decontaminate.find(frame(spark, given), bench, 10, block_bytes=limit).collect()}
    assert got == brute_hits(given, items, 10)
    assert decontaminate.find(frame(spark, given), bench.limit(0), 10).filter(F.size("hits") > 0).count() == 0


def test_kd_shards(spark):
    rng = random.Random(7)
    given = [None, "", *("word " * rng.randint(1, 300) + "é" * rng.randint(0, 50) + "\n" * rng.randint(0, 5) for _ in range(600)), *["a copy of thirty bytes or more "] * 400]
    docs = frame(spark, given)
    rows = kd_shards.shards(docs, 8).collect()
    assert len(rows) == len(given)
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        b = (given[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 16, zlib.crc32(b))
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(load.values()) / 8
    assert max(abs(v - mean) for v in load.values()) < 0.1 * mean
    assert kd_shards.shards(docs.limit(0), 8).count() == 0
    assert len({r.shard for r in kd_shards.shards(docs.limit(3), 8).collect()}) <= 3


def test_kd_shards_keep_groups_and_divide_hot_ones(spark):
    """Groups of equal texts that a cut can spare stay whole; one of a third of all bytes is shared out; repeated ids and clashing names."""
    rng = random.Random(18)
    small = [f"copy {g} {'z' * 30}" for g in range(40) for _ in range(3)]
    hot = ["hot " * 30] * 500
    given = [*small, *hot, *("w" * rng.randint(60, 180) + str(i) for i in range(900))]
    docs = spark.createDataFrame([(i // 2, t, 1, "x") for i, t in enumerate(given)], "doc_id long, text string, shard int, node string")
    rows = kd_shards.shards(docs, 8).collect()
    groups, load = defaultdict(set), defaultdict(int)
    for r in rows:
        groups[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
    assert all(len(groups[zlib.crc32(t.encode())]) == 1 for t in small)
    assert len(groups[zlib.crc32(hot[0].encode())]) > 1 and sum(load.values()) == sum(len(t) + 16 for t in given)
    mean = sum(load.values()) / 8
    assert max(abs(v - mean) for v in load.values()) < 0.06 * mean


def test_html_extract_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, host int"
    rows = [(1, "http://x/", "<article><p>One</p></article>", "t", 1)] * 3 + [(None, None, "<p>" + "word " * 200_000, "t", 2)]
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect())
    assert got[1:] == [(1, "One")] * 3 and len(got[0][1].split()) == 200_000
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_html_extract(spark):
    page = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
    <body class="no-comments"><header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div id="cookie-notice">We use</div><main><article class="post"><header><h1>A &amp; B</h1><p>by line</p></header><p>One<br>two &lt;3&nbsp; three<p><b>Four
    five</b> <i>six</i>.<form><input><p>mail</p></form><blockquote>Quote</blockquote><ul><li>x<li>y</ul><aside>more</aside><div class="share">Share</div>
    <p hidden>no</p><table><tr><td>c1<td>c2</table>5 < 6</article><section id="comments"><article class="comment"><p>Nice long comment text that is no article at all</p></article></section></main>
    <footer>&copy; x</footer></body></html>"""
    assert "\n".join(html_extract.blocks(page)[0]) == "A & B\nOne two <3 three\nFour five six.\nQuote\nx\ny\nc1\nc2\n5 < 6"
    assert html_extract.blocks(None)[0] == html_extract.blocks("")[0] == []
    assert html_extract.blocks("plain &am; text")[0] == ["plain &am; text"]
    assert len(html_extract.blocks("<div>" * 5000 + "deep")[0]) == 1
    shared = "<div><p>Join our club today</p><p>It is free</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body><p>Text number {i} of the site.</p>{shared}</body>") for i in range(20)]
    rows += [(20, "https://b.example/x", f"<body><p>Other.</p>{shared}</body>"), (21, None, None), (22, "nohost", "")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text number 3 of the site." and got[20] == "Other.\nJoin our club today\nIt is free" and got[21] == got[22] == ""


@pytest.mark.parametrize("keys", [1 << 20, 0])
def test_html_templates_of_a_part_of_a_large_host(spark, monkeypatch, keys):
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    page = lambda i, more: f"<body><p class=nav><b>x</b></p><article><p>Own text {i} of it.</p><p>Said often.</p>{more}</article></body>"
    often, body = "<div><p>Join our club</p></div>", "<div><p>The same report in each copy of it.</p></div>"
    rows = [(i, f"https://a.example/{i}", page(i, often if i < 6 else "")) for i in range(60)]
    rows += [(100 + i, f"https://a.example/c{i}", f"<title>{i}</title><article>{body}</article>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(60)} == {f"Own text {i} of it.\nSaid often." for i in range(60)}
    assert {got[100 + i] for i in range(8)} == {"The same report in each copy of it."}
    assert any(h for h in html_extract.subtrees("<nav><p>Home</p></nav><article><p>x</p></article>", "a")[0] if h in html_extract.subtrees("<nav><p>Home</p></nav><p>y</p>", "a")[0])


def toxic_tables(spark, n=400):
    rng = random.Random(9)
    filler, bad = [f"w{i}" for i in range(300)], [f"grumble{x}" for x in "abcdefghij"]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 8 == 0
        w = [rng.choice(filler) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    rows += [(n, None), (n + 1, ""), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_toxicity(spark):
    docs, labels, truth = toxic_tables(spark)
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    assert {r.score for r in got if r.doc_id >= 400} == {model.calibrated(model.prior)}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_toxicity_of_odd_tables(spark, monkeypatch):
    docs, labels, _ = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, "w1 grumblea grumbleb grumblec w2", "x", 0.5)] * 2 + [(2, "w1 " * 50_000 + "grumblea grumbleb grumblec", "x", 0.5), (None, None, "y", 0.1)], "doc_id long, text string, label string, score double")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id is not None}) == 1 and {r.doc_id for r in got if r.score >= queries.TOXIC} == {1, 2}
    monkeypatch.setattr(tn, "CHUNK_BYTES", 100)
    assert sorted(r.score for r in toxicity.score(odd.coalesce(1), model).collect()) == sorted(r.score for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert len({r.score for r in toxicity.score(odd, one).collect()}) == 1
    empty = toxicity.fit(docs.limit(0), labels)
    assert len({r.score for r in toxicity.score(odd, empty).collect()}) == 1


def test_toxicity_terms_against_plain_counts(spark):
    """The vocabulary by plain counts over words and their beginnings."""
    docs, labels, truth = toxic_tables(spark)
    rows = {r.doc_id: (r.text or "") for r in docs.collect() if r.doc_id in truth}
    have = {i: {x for w in t.split() for x in (w, *(w[:k] + "*" for k in (4, 5) if len(w) > k))} for i, t in rows.items()}
    n1, n0 = sum(truth.values()), len(truth) - sum(truth.values())
    tested = {x: (sum(x in have[i] for i in truth if truth[i]), sum(x in have[i] for i in truth if not truth[i])) for x in set().union(*have.values())}
    tested = {x: c for x, c in tested.items() if sum(c) >= 3}
    level = toxicity._beyond(0.01 / len(tested))
    chosen = {x for x, (a, b) in tested.items() if (n1 + n0) * (a * n0 - b * n1) ** 2 / (n1 * n0 * (a + b) * max(n1 + n0 - a - b, 1)) >= level and not 1 / 16 < (a + 0.5) * (n0 - b + 0.5) / ((n1 - a + 0.5) * (b + 0.5)) < 16}
    model = toxicity.fit(docs, labels)
    assert len(model.known) == len(chosen) > 5 and all(x.startswith("grum") for x in chosen)


def test_toxicity_neighbours_are_exact(spark):
    docs, labels, _ = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    n = len(model.toxic)
    dense = np.zeros((n, len(model.known)))
    for t in range(len(model.known)):
        a, b = model.start[t : t + 2]
        dense[model.example[a:b], t] = model.value[a:b]
    rng = np.random.default_rng(2)
    for _ in range(50):
        terms = np.sort(rng.choice(len(model.known), size=min(4, len(model.known)), replace=False))
        counts = rng.integers(1, 5, len(terms))
        q = (1 + np.log(counts)) * model.idf[terms]
        sims = dense[:, terms] @ (q / np.sqrt((q * q).sum()))
        best = np.lexsort((np.arange(n), -np.round(sims, 12)))[: toxicity.NEIGHBOURS]
        ids, got = model.nearest(terms, counts)
        keep = sims[best] > 0
        assert np.allclose(got, sims[best][keep]) and ids.tolist() == best[keep].tolist()


def test_toxicity_of_a_rare_kind(spark):
    """A kind with one in a hundred of the toxic rows still has its terms."""
    rng = random.Random(12)
    say = lambda: " ".join(f"w{rng.randrange(200)}" for _ in range(12))
    rows = [(i, f"{say()} {'' if i % 2 else 'zzrare' if i % 200 == 0 else 'grumble'}", i % 2 == 0) for i in range(7000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(t)) for i, _, t in rows], "doc_id long, toxic int"))
    new = spark.createDataFrame([(k, f"{say()} {x}") for k, x in enumerate(["zzrare", "grumble", ""])], "doc_id long, text string")
    assert [r.score >= queries.TOXIC for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [True, True, False]


def test_toxicity_counts_frequencies_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "GATHERED", 200)
    docs, labels, _ = toxic_tables(spark)
    docs = docs.union(spark.createDataFrame([(1000 + i, f"{'grumblea ' * (i % 3)}own{i}") for i in range(300)], docs.schema))
    model = toxicity.fit(docs, labels)
    raw, off = tn.utf8(__import__("pyarrow").array(["grumblea"]))
    at = int(np.flatnonzero(model.known == tn.Words(raw, off, tn.ALNUM).hash[0])[0])
    given = [(r.text or "").split() for r in docs.collect()]
    assert np.isclose(model.idf[at], np.log((1 + len(given)) / (1 + sum("grumblea" in w for w in given))) + 1)


def test_language_id(spark):
    words = {"en": "the and of with that this have from they which", "fr": "le la des une avec pour dans nous vous être", "de": "der die und nicht mit ein sich auch wird über"}
    rng = random.Random(3)
    say = lambda lang, k: " ".join(rng.choice(words[lang].split()) for _ in range(k))
    docs = spark.createDataFrame([(say(x, 40), x) for x in words for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    rows = [(i, f"https://{x}.example.{x}/{i}", f'<html lang="{x}"><p>{say(x, 30)}</p></html>') for i, x in enumerate([*words] * 10)]
    rows += [(100, "https://fr.example.fr/", ""), (101, "https://fr.example.fr/x", None), (102, None, f"<p>{say('de', 30)}</p>")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert all(got[i].lang == x for i, x in enumerate([*words] * 10))
    assert got[100].lang == got[101].lang == "fr" and got[100].text_lang is None and got[102].lang == "de"
    none = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs.limit(0)).collect()
    assert {r.lang for r in none} == {None}


def test_language_id_of_odd_tables(spark):
    docs = spark.createDataFrame([("the and of with that", "en"), ("le la des une avec", "fr")] * 10, "text string, lang string")
    schema = "page_id long, url string, html string, lang string, host int"
    rows = [(1, "http://a.fr/", "<p>" + "avec une des la " * 50, "x", 1)] * 3 + [(2, "http://a.fr/", "<p>" + "with that and of " * 30_000, "x", 1)]
    got = language_id.identify(spark.createDataFrame(rows, schema), docs).collect()
    assert sorted((r.page_id, r.lang) for r in got) == [(1, "fr")] * 3 + [(2, "en")] and len({r.probability for r in got if r.page_id == 1}) == 1
    assert language_id.identify(spark.createDataFrame([], schema), docs).count() == 0


def test_language_id_by_brute_force(spark):
    """Posteriors by plain loops over counts, from the operator's own text likelihoods."""
    rng = random.Random(19)
    words = {"en": "the and of with that", "fr": "le la des une avec"}
    docs = spark.createDataFrame([(" ".join(rng.choice(words[x].split()) for _ in range(30)), x) for x in words for _ in range(10)], "text string, lang string")
    rows = []
    for i in range(40):
        x = rng.choice(["en", "fr"])
        body = " ".join(rng.choice(words[x if rng.random() < 0.8 else "en"].split()) for _ in range(rng.choice([0, 1, 2, 8])))
        rows.append((i, f"http://{rng.choice(['a', 'b'])}.site{rng.randrange(2)}.{rng.choice(['com', 'fr'])}/", f"<html{rng.choice(['', ' lang=en', ' lang=fr'])}><p>{body}</p>"))
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    names, table = language_id.likelihoods(docs)
    table = (table - table.mean(axis=0)).astype(np.float32)
    logs, pages = {}, {}
    for i, url, html in rows:
        code, _ = language_id._trigrams(*arrow(language_id._MARKUP.sub(" ", html)))
        weight = min(language_id.TEMPER, language_id.MOST / max(len(code), 1))
        logs[i] = [float(table[k][code].astype(float).sum()) * weight for k in range(2)]
        host = url.split("/")[2]
        verdict = None if not any(logs[i]) else int(np.argmax(logs[i]))
        pages[i] = {"host": host, "domain": host.split(".", 1)[1], "suffix": host.rsplit(".", 1)[1], "declared": language_id.declared(html), "verdict": verdict}
    total = [sum(p["verdict"] == k for p in pages.values()) for k in range(2)]
    base = [(t + 1) / (sum(total) + 2) for t in total]

    def counts(column, i, own):
        return [sum(p["verdict"] == k and p[column] == pages[i][column] for j, p in pages.items() if own or j != i) for k in range(2)]

    for i, p in pages.items():
        prior = base
        for column in ("domain", "host"):
            c = counts(column, i, False)
            prior = [(c[k] + 4 * prior[k]) / (sum(c) + 4) for k in range(2)]
        score = [logs[i][k] + np.log(prior[k]) for k in range(2)]
        for column in ("declared", "suffix"):
            c = counts(column, i, True)
            if p[column] is not None and sum(c):
                score = [score[k] + np.log((c[k] + base[k]) / (total[k] + 1)) for k in range(2)]
        mass = sum(np.exp(x - max(score)) for x in score)
        assert np.isclose(got[i].probability, 1 / mass, atol=1e-4), i
        assert got[i].lang == names[int(np.argmax(score))] or np.isclose(score[0], score[1], atol=1e-6)


def test_declared_language_is_found_behind_a_long_prefix():
    assert language_id.declared(f"<!-- {'licence ' * 2000} <html lang=xx> -->{' ' * 9000}<!DOCTYPE html>\n<HTML class=a LANG='FR-ca'><p lang=de>") == "fr"
    assert language_id.declared("<html><p>" + "<html lang=de>") is None and language_id.declared("<p lang=de>") is None and language_id.declared("<!-- <html lang=de>") is None


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, _own int, _ID int")
    assert common.fresh(df, "_own", "_id", "_new") == ["_own_", "_id_", "_new"]
    keys = common.keyed(df)
    assert common.without(df, keys, "t").count() == 0 and common.without(df, keys.limit(0), "t").columns == df.columns


def test_queries_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
