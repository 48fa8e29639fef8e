"""Benchmark decontamination: which words of each document lie in a passage of a benchmark item.

A window is ``n`` consecutive item words (a shorter item is one window). Containment of a whole
window needs every one of its shingles, so one necessary shingle is enough as its prefix: the
rarest over all documents, counted in a first pass. A second pass looks the prefix shingles up in
each document; a match at a position fixes where the window would begin, so length and position
bounds apply, then the hash of the whole window, and last its words.

The benchmark is taken in blocks of bounded bytes, each broadcast; a benchmark of one block, the
usual case, needs no shuffle but the counts. Passes are narrow and keep no text.

Cases: a null text, of a document or an item, has no words. Repeated items count once by their id;
an item without an id marks words but is not listed. Repeated documents are each reported. An empty
benchmark hits nothing, and an empty table of documents gives no rows. A very long text is taken
whole, its words in blocks. Equally rare shingles go by hash. Columns besides key and text are left
out, so their names cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

#: Words of a prefix shingle.
SHINGLE = 5
#: Bytes of item text in a block; its windows, of about 60 bytes each, are what is broadcast.
BLOCK_BYTES = 1 << 22


@dataclass
class Windows:
    """The windows of a block of items, sorted by their size and prefix shingle."""

    size: np.ndarray
    hash: np.ndarray
    item: np.ndarray
    words: list[bytes]
    parts: np.ndarray  # hashes of all shingles of a window, one row each window, 0 where it has fewer
    ids: list[str | None]
    prefix: np.ndarray | None = None
    place: np.ndarray | None = None

    @property
    def part_size(self) -> np.ndarray:
        return np.minimum(self.size, SHINGLE)


def windows(items: list[tuple[str | None, str | None]], n: int) -> Windows:
    raw, off = tn.utf8(pa.array([t for _, t in items], type=pa.string()))
    words = tn.Words(raw, off, tn.ALNUM)
    prefix = words.prefix()
    size, start, item = [], [], []
    for k, (first, count) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=False)):
        long = min(n, count)
        for at in range(first, first + count - long + 1) if count else ():
            size.append(long)
            start.append(at)
            item.append(k)
    size, start, item = (np.array(x, dtype=np.int64) for x in (size, start, item))
    parts = np.zeros((len(size), max(1, n - SHINGLE + 1)), dtype=np.uint64)
    if len(size):
        part = np.minimum(size, SHINGLE)
        for k in range(parts.shape[1]):
            has = k + part <= size
            parts[has, k] = words.window(prefix, start[has] + k, part[has])
    text = [b" ".join(words.text(i) for i in range(s, s + z)) for s, z in zip(start.tolist(), size.tolist(), strict=True)]
    return Windows(size, words.window(prefix, start, size) if len(size) else np.zeros(0, np.uint64), item, text, parts, [i for i, _ in items])


def _sorted_shingles(w: Windows) -> dict[int, np.ndarray]:
    """The distinct shingles of the windows, by their number of words."""
    return {int(s): np.unique((got := w.parts[w.part_size == s])[got != 0]) for s in np.unique(w.part_size)}


def _positions(words: tn.Words, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all shingles of so many words within one document each."""
    made = np.maximum(words.count - size + 1, 0)
    start = np.repeat(words.first[:-1] - (np.cumsum(made) - made), made) + np.arange(made.sum())
    return start, words.window(prefix, start, size)


def _count(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences of the shingles over all documents: summed in each task, then over tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: tn.Lookup(k) for s, k in sent.value.items() if len(k)}
        total = {s: np.zeros(len(t.known), dtype=np.int64) for s, t in tables.items()}
        for batch in batches:
            raw, off = tn.utf8(batch.column("text"))
            for i, j in tn.chunks(off):
                words = tn.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], tn.ALNUM)
                prefix = words.prefix()
                for s, table in tables.items():
                    _, at = table.find(_positions(words, prefix, s)[1])
                    total[s] += np.bincount(at, minlength=len(table.known))
        for s, counts in total.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["size", "at", "n"])

    out = {s: np.zeros(len(k), dtype=np.int64) for s, k in shingles.items()}
    counted = docs.select("text").mapInArrow(common.lean(run), "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each shingle of the block at most
        out[r["size"]][r["at"]] = r["n"]
    return out


def choose(w: Windows, shingles: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> None:
    """Gives each window its rarest shingle as prefix; ties go to the lower hash."""
    if not len(w.size):
        w.prefix, w.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return
    seen = np.full(w.parts.shape, np.iinfo(np.int64).max)
    for s, known in shingles.items():
        rows, k = np.nonzero((w.part_size == s)[:, None] & (w.parts != 0))
        seen[rows, k] = counts[s][np.searchsorted(known, w.parts[rows, k])]
    best = np.lexsort((w.parts, seen), axis=1)[:, 0]
    w.place = best.astype(np.int64)
    w.prefix = w.parts[np.arange(len(best)), best]


HITS = "row long, n_words long, hits array<struct<first:int,last:int>>, items array<string>"


def _hits(docs: DataFrame, w: Windows, every: bool) -> DataFrame:
    """key, text_hash, n_words, hits as ranges of word numbers, and items; of all documents or of those with a hit."""
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        tables = {}
        for s in np.unique(w.part_size).tolist():
            own = np.flatnonzero(w.part_size == s)
            own = own[np.argsort(w.prefix[own], kind="stable")]
            known, first, count = np.unique(w.prefix[own], return_index=True, return_counts=True)
            tables[s] = tn.Lookup(known), own, first, count
        for batch in batches:
            raw, off = tn.utf8(batch.column("text"))
            for i, j in tn.chunks(off):
                words = tn.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], tn.ALNUM)
                prefix, doc_of = words.prefix(), words.doc_of()
                starts, found = [], []
                for s, (table, own, first, count) in tables.items():
                    begin, hashes = _positions(words, prefix, s)
                    at, known = table.find(hashes)
                    times = count[known]
                    which = own[np.repeat(first[known] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                    start = np.repeat(begin[at], times) - w.place[which]
                    doc = np.repeat(doc_of[begin[at]], times) if len(at) else np.zeros(0, np.int64)
                    fits = (start >= words.first[doc]) & (start + w.size[which] <= words.first[doc + 1])
                    start, which = start[fits], which[fits]
                    same = words.window(prefix, start, w.size[which]) == w.hash[which] if len(start) else np.zeros(0, bool)
                    starts.append(start[same])
                    found.append(which[same])
                start, which = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])
                true = [b" ".join(words.text(x) for x in range(a, a + w.size[k])) == w.words[k] for a, k in zip(start.tolist(), which.tolist(), strict=True)]
                start, which = start[np.array(true, dtype=bool)], which[np.array(true, dtype=bool)]
                hits: list[list] = [[] for _ in range(j - i)]
                items: list[set] = [set() for _ in range(j - i)]
                for a, k in sorted(zip(start.tolist(), which.tolist(), strict=True)):
                    d = int(doc_of[a])
                    a, b = a - int(words.first[d]), a - int(words.first[d]) + int(w.size[k])
                    if hits[d] and a <= hits[d][-1][1]:
                        hits[d][-1] = hits[d][-1][0], max(b, hits[d][-1][1])
                    else:
                        hits[d].append((a, b))
                    if w.ids[w.item[k]] is not None:
                        items[d].add(w.ids[w.item[k]])
                keep = [d for d in range(j - i) if every or hits[d]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(i, j - i).take(pa.array(keep, pa.int64())),
                        batch.column("text_hash").slice(i, j - i).take(pa.array(keep, pa.int64())),
                        pa.array(words.count[keep], pa.int64()),
                        pa.array([[{"first": a, "last": b} for a, b in hits[d]] for d in keep], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                        pa.array([sorted(items[d]) for d in keep], pa.list_(pa.string())),
                    ],
                    names=["key", "text_hash", "n_words", "hits", "items"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(common.lean(run), f"key {kind}, text_hash long, n_words long, hits array<struct<first:int,last:int>>, items array<string>")


def blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, as many at a time as the limit lets in; the driver holds one block."""
    held, size = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        held.append((r.i, r.t))
        size += len((r.t or "").encode()) + 16
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, hits (ranges of word numbers that lie in windows, in order and apart) and items (ids as strings, in order) of every row."""
    scratch = None
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    parts: list[DataFrame] = []
    for block in itertools.chain(blocks(benchmark, item, item_text, block_bytes)):
        w = windows(block, n)
        shingles = _sorted_shingles(w)
        choose(w, shingles, _count(own, shingles) if len(w.size) else {})
        parts.append(_hits(own, w, every=not parts))
    if not parts:
        parts = [_hits(own, windows([], n), every=True)]
    if len(parts) == 1:
        return parts[0].drop("text_hash").withColumnRenamed("key", key)
    scratch = common.Scratch(docs.sparkSession, "decontaminate")
    first, *rest = (scratch.table(p, f"block{k}") for k, p in enumerate(parts))
    more = rest[0]
    for p in rest[1:]:
        more = more.unionByName(p)
    more = more.distinct().groupBy("key", "text_hash").agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("items")).alias("i"))
    merged = F.aggregate(
        F.array_sort(F.concat("hits", F.coalesce("h", F.array().cast("array<struct<first:int,last:int>>")))),
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"), F.greatest(F.get(acc, F.size(acc) - 1)["last"], x["last"]).alias("last")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    a, b = first.alias("a"), more.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    return joined.select(F.col("a.key").alias(key), "n_words", merged.alias("hits"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>"))))).alias("items"))
