"""Spelling variants of a corpus' words by Aho-Corasick automata over halves.

One pass over the texts takes the words (runs of Latin letters) on flat bytes and sums them up
before they leave a task. Of two words at distance one, each holds one half of the other where it
was: the first half at the start or the second at the end. So every word is sent twice, by its
first three code points and by its last three, to the shards that can hold a half which it begins
or ends with; a shard builds one automaton over the halves of its words, scans all words sent to
it, and keeps hits at the right offset and of a compatible length. What is left of both words must
be at distance one: hashes of these rests with one code point deleted or masked meet in sorted
arrays, so that words which share a half are never compared all with all, and every pair that
meets is verified on the words. A word's near words are counted and their best taken within the
shard; only these sums are shuffled.

Three code points that more than SHARD words share are dealt over several shards: each holds some
of these words' halves, and all of the words are scanned there.

Cases: a null or empty text has no words; each row counts, repeated rows and ids too; a null id is
written as nothing before the colon; ties in n go to the smallest word in code-point order; words
and texts of any length are taken whole, a text in windows that end between words; an empty table
gives no rows. Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

#: Words whose halves stand in one automaton, at about, and code points of these words.
SHARD, SHARD_CHARS = 1 << 16, 1 << 21
#: Bytes of a run up to which checksums go side by side; longer ones are taken one by one.
_SIDE_BY_SIDE = 64
_ALL = 0xFFFFFFFF


def _crc_table() -> np.ndarray:
    """Of the reversed polynomial 0xEDB88320, for one byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def letters(raw: np.ndarray) -> np.ndarray:
    """Whether a byte is of a letter A-Z, a-z or U+00C0 to U+00FF (the two bytes C3 80 to C3 BF)."""
    lead = raw == 0xC3
    out = _ASCII_LETTER[raw] | lead
    out[1:] |= lead[:-1]
    return out


def _windows(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and whether they are letters, of texts side by side or of windows of a long one, which end outside runs."""
    for i, j in tn.chunks(off):
        a, end = int(off[i]), int(off[j])
        if j - i > 1 or end - a <= 2 * tn.CHUNK_BYTES:
            yield raw[a:end], off[i : j + 1] - off[i], np.arange(i, j)
            continue
        while a < end:
            b = min(end, a + tn.CHUNK_BYTES)
            while b < end:
                gap = np.flatnonzero(~letters(raw[a:b]))
                if len(gap) and gap[-1]:
                    b = a + int(gap[-1])
                    break
                b = min(end, b + tn.CHUNK_BYTES)
            yield raw[a:b], np.array([0, b - a]), np.array([i])
            a = b


def checksums(raw: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of raw[start : start + size] behind bytes of the crc32 before, for all runs."""
    out = np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    many = int(np.searchsorted(-size[order], -_SIDE_BY_SIDE))
    for k in order[:many].tolist():
        out[k] = zlib.crc32(raw[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    order = order[many:]
    state, at, length = before[order] ^ np.uint32(_ALL), start[order], size[order]
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t))
        state[:n] = _CRC[(state[:n] ^ raw[at[:n] + t]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(_ALL)
    return out


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and where each begins in raw less where it begins there."""
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    at = np.arange(int(size.sum())) + shift
    return raw[at], at


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    up, down = tn._BYTES.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tn._BYTE_VALUE[data] * up[: len(data)], dtype=np.uint64)))
        return tn.mix64((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))


def _count(text: pa.Array, ids: list[str | None], length: int, drop: int | None) -> Iterator[pa.RecordBatch]:
    raw_all, off_all = tn.utf8(text)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    for raw, off, docs in _windows(raw_all, off_all):
        if not len(raw):
            continue
        letter = letters(raw)
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[off] = True
        before, after = np.concatenate(([False], letter[:-1])), np.concatenate((letter[1:], [False]))
        start = np.flatnonzero(letter & (~before | edge[:-1]))
        size = np.flatnonzero(letter & (~after | edge[1:])) + 1 - start
        leads = np.concatenate(([0], np.cumsum(raw == 0xC3)))
        points = size - (leads[start + size] - leads[start])
        some = points >= length
        start, size, points = start[some], size[some], points[some]
        folded = tn._FOLDED[raw]
        if drop:
            doc = docs[np.searchsorted(off, start, side="right") - 1]
            crc = checksums(folded, start, size, heads[doc]).astype(np.int64)
            odd = crc % drop == 0
            lost = odd & (points > length)
            if lost.any():
                # The bytes of the code point to delete: it begins at the byte that is its number plus the lead bytes before it.
                data, at = _gather(folded, start[lost], size[lost])
                first = data & 0xC0 != 0x80
                starts = np.cumsum(size[lost]) - size[lost]
                number = np.cumsum(first) - 1
                number -= np.repeat(number[starts], size[lost])
                keep = number != np.repeat(crc[lost] % points[lost], size[lost])
                kept = np.add.reduceat(keep, starts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([_strings(data[keep], kept), pa.array(np.ones(len(kept), np.int64))], names=["word", "n"])
            start, size = start[~odd], size[~odd]
        if len(start):
            _, pick, times = np.unique(_hashes(folded, start, size), return_index=True, return_counts=True)
            data, _ = _gather(folded, start[pick], size[pick])
            yield pa.RecordBatch.from_arrays([_strings(data, size[pick]), pa.array(times.astype(np.int64))], names=["word", "n"])


def words(docs: DataFrame, length: int = 7, drop: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n (occurrences) of all runs [A-Za-z\\u00C0-\\u00FF]+ of at least so many code points, A-Z in lower case.

    With drop, a run whose crc32 of "<key>:<run>" drop divides loses the code point at that checksum modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _count(batch.column("text"), batch.column("key").to_pylist(), length, drop)

    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near(x: str, y: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes x of y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    a, b = 0, len(x)
    while a < b:  # the length of the common beginning
        m = (a + b + 1) // 2
        a, b = (m, b) if x[:m] == y[:m] else (a, m - 1)
    return x[a + (len(x) == len(y)) :] == y[a + 1 :]


class _Flat:
    """Code points of words one after another, for hashes of their parts with a code point deleted or masked."""

    def __init__(self, words: list[str]) -> None:
        self.edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        up, self.down = tn._WORDS.get(len(points) + 2)
        with np.errstate(over="ignore"):
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tn.mix64(points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)))

    def keys(self, word: np.ndarray, side: np.ndarray, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For what the words have beside their first (side 0) or last part code points, with own mixed in: a key of the whole; keys with one deleted and with one masked; and the places whose these are."""
        a = self.edge[word] + np.where(side == 0, part, 0)
        b = self.edge[word + 1] - np.where(side == 0, 0, part)
        size = b - a
        who = np.repeat(np.arange(len(word)), size)
        i = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
        u = lambda x: x.astype(np.uint64)
        with np.errstate(over="ignore"):
            seed = tn.mix64(u(own) + np.uint64(1))
            length = tn.mix64(u(size) + np.uint64(7))
            shorter = tn.mix64(u(size) + np.uint64(6))
            whole = tn.mix64((self.total[b] - self.total[a]) * self.down[a] + seed + length)
            cut = ((self.total[i] - self.total[a[who]]) + (self.total[b[who]] - self.total[i + 1]) * self.down[1]) * self.down[a[who]] + seed[who]
            return whole, tn.mix64(cut + shorter[who]), tn.mix64(cut ^ tn.mix64(u(i - a[who]) + length[who])), who


def _meet(own: np.ndarray, owner: np.ndarray, asked: np.ndarray, asker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """asker and owner of all equal keys."""
    order = np.argsort(own, kind="stable")
    own, owner = own[order], owner[order]
    low, high = np.searchsorted(own, asked, side="left"), np.searchsorted(own, asked, side="right")
    times = high - low
    some = times > 0
    low, times, asker = low[some], times[some], asker[some]
    at = np.arange(int(times.sum())) + np.repeat(low - (np.cumsum(times) - times), times)
    return np.repeat(asker, times), owner[at]


class Shard:
    """An automaton over the halves of some words (the first half on side 0, the second on side 1)."""

    def __init__(self, words: list[str], n: list[int], sides: list[int]) -> None:
        import ahocorasick

        self.words, self.n, self.sides = words, np.array(n, dtype=np.int64), np.array(sides, dtype=np.int64)
        self.halves: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        half = np.zeros(len(words), dtype=np.int64)
        for k, (w, side) in enumerate(zip(words, sides, strict=True)):
            h = w[len(w) // 2 :] if side else w[: len(w) // 2]
            number = self.halves.setdefault(h, len(self.halves))
            if number == len(self.halves) - 1:
                self.automaton.add_word(h, (number, len(h)))
            half[k] = 2 * number + side
        self.automaton.make_automaton()
        size = np.fromiter(map(len, words), np.int64, len(words))
        rank = np.empty(len(words), dtype=np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.rank = rank
        index = np.arange(len(words))
        self.whole, self.cut, self.masked, self.who = _Flat(words).keys(index, self.sides, np.where(self.sides == 0, size // 2, size - size // 2), half)

    def scan(self, words: list[str], sides: list[int]) -> pa.RecordBatch | None:
        """word, n_near, form_n and form (the best near word) of the words that have near ones among the shard's of their side."""
        row, number, part = [], [], []
        for k, (w, side) in enumerate(zip(words, sides, strict=True)):
            last = len(w) - 1
            # Halves of words that are one code point shorter, as long, or one longer.
            if side:
                low, high = len(w) // 2, (len(w) + 2) // 2
            else:
                low, high = (len(w) - 1) // 2, (len(w) + 1) // 2
            for end, (half, size) in self.automaton.iter(w):
                if low <= size <= high and (end == last if side else end + 1 == size):
                    row.append(k)
                    number.append(2 * half + side)
                    part.append(size)
        if not row:
            return None
        row, part, number = np.array(row), np.array(part), np.array(number)
        whole, cut, masked, who = _Flat(words).keys(row, number & 1, part, number)
        index, hit = np.arange(len(self.words)), np.arange(len(row))
        met = [_meet(self.masked, self.who, masked, who), _meet(self.cut, self.who, whole, hit), _meet(self.whole, index, cut, who)]
        x, y = row[np.concatenate([m[0] for m in met])], np.concatenate([m[1] for m in met])
        pair = np.unique(x * len(self.words) + y)
        x, y = pair // len(self.words), pair % len(self.words)
        own = self.words
        # A pair that meets by the first half is not counted by the second.
        good = [near(words[i], own[j]) and not (sides[i] and words[i].startswith(own[j][: len(own[j]) // 2])) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        x, y = x[good], y[good]
        if not len(x):
            return None
        order = np.lexsort((self.rank[y], -self.n[y], x))
        x, y = x[order], y[order]
        first = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
        times = np.diff(np.concatenate((first, [len(x)])))
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in x[first].tolist()]), pa.array(times), pa.array(self.n[y[first]]), pa.array([own[j] for j in y[first].tolist()])], names=["word", "n_near", "form_n", "form"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (side, ends, salt, salts, own, word, n) in order of side, ends, salt and own, own ones first."""
    held: list[tuple[str, int, int]] = []
    group: tuple | None = None  # of several shards; the others are put together
    shard: Shard | None = None
    rest: list[tuple[str, int, int]] = []

    def build() -> tuple[Shard, pa.RecordBatch | None]:
        columns = [list(c) for c in zip(*held, strict=True)]
        held.clear()
        made = Shard(*columns)
        return made, made.scan(columns[0], columns[2])

    def full(rows: list) -> bool:
        return len(rows) >= SHARD or sum(len(r[0]) for r in rows[-1024:]) * len(rows) >= SHARD_CHARS * min(1024, len(rows))

    for batch in batches:
        for side, ends, salt, salts, own, word, n in zip(*(batch.column(c).to_pylist() for c in ("side", "ends", "salt", "salts", "own", "word", "n")), strict=True):
            now = (side, ends, salt) if salts > 1 else None
            if now != group:
                if rest:
                    yield shard.scan([r[0] for r in rest], [r[2] for r in rest])
                if held:
                    yield build()[1]
                rest, shard, group = [], None, now
                last = None
            if now is None:
                if held and (side, ends) != last and full(held):
                    yield build()[1]
                held.append((word, n, side))
                last = (side, ends)
            elif own:
                held.append((word, n, side))
            else:
                if held:
                    shard, made = build()
                    yield made
                rest.append((word, n, side))
                if shard and full(rest):
                    yield shard.scan([r[0] for r in rest], [r[2] for r in rest])
                    rest = []
    if rest and shard:
        yield shard.scan([r[0] for r in rest], [r[2] for r in rest])
    if held:
        yield build()[1]


def _near(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, form_n and form of the words with near ones."""
    shards = common.partitions(vocabulary.sparkSession)
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, 3).alias("ends")), F.struct(F.lit(1).alias("side"), F.substring("word", -3, 3).alias("ends")))
    sent = vocabulary.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.side", "e.ends")
    # Three letters of 62 and 2 sides; a row stands for more than SHARD words.
    hot = sent.groupBy("side", "ends").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SHARD).select("side", "ends", F.ceil(F.col("c") / SHARD).cast("int").alias("salts"))
    salted = sent.join(F.broadcast(hot), ["side", "ends"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = salted.withColumn("home", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = dealt.select("side", "ends", "salt", "salts", (F.col("home") == F.col("salt")).alias("own"), "word", "n")
    rows = rows.repartition(shards, "side", "ends", "salt").sortWithinPartitions("side", "ends", "salt", F.col("own").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (b for b in _search(batches) if b is not None)

    found = rows.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def group(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words (of six code points at least) and their n.

    form is the near word of the largest n (ties: the smallest), if that is times the word's n at least, and root what following forms ends at.
    """
    scratch = common.Scratch(vocabulary.sparkSession, "spelling")
    held = scratch.table(vocabulary.select("word", "n"), "words")
    joined = held.join(_near(held), "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    own = scratch.table(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "near")
    # Each step multiplies n, so a chain has at most as many words as n has digits (to the base of times), and each round doubles what is followed.
    roots, k = scratch.table(own.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = scratch.table(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), f"roots-{k + 1}")
        k += 1
        roots = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            break
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, length: int = 7, least: int = 2, times: int = 10, drop: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`group` of the :func:`words` that occur at least so often."""
    return group(words(docs, length, drop, key, text).filter(F.col("n") >= least), times)
