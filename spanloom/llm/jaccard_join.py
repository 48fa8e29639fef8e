"""Exact set-similarity self-join on word shingles, by set relations.

Two sets link when their Jaccard similarity reaches a threshold. The join uses

* equal sets: one pass gives each document a 128-bit mark of its set; equal marks are one class,
  whatever the number of copies, and only classes are joined;
* prefixes: a fixed-size sketch counts all shingles of all documents, and orders them by rarity
  (count, then hash). Linked sets share a shingle among the first |x| - ceil(t |x|) + 1 of each;
* index-level skipping: a shingle's list is kept sorted in blocks by position and size, and a whole
  block is skipped where position and size bound the overlap below what a link needs. A list that
  is longer than a task should take pairwise only ties its sets together in a chain;
* answer-level skipping: sets tied by lists are put side by side, in blocks of bounded size. A few
  sets of a block have all their overlaps counted. Any other set's answer is derived from that of
  the most similar of these: what the two do not share bounds how far their overlaps with a third
  set can differ, and only where that leaves a link open the set's own overlaps are counted. Blocks
  are first joined with themselves and with their cluster's first block; from then on a set that is
  already connected to most of its cluster needs no more, and only the others meet every block, first
  by parities of fixed size, which bound an overlap, and as whole sets only where these leave a link open.

Nothing is sampled or capped: the chain and the later rounds are exact ways for long lists. Pairs
within a group of copies are never made into rows; a block gives a spanning forest of its links.

Cases: null or empty texts have no shingles and link with nothing; a text of fewer words than a
shingle has its whole sequence as its one shingle; rows that share a doc_id are one node; rows
without a doc_id get no component; an empty table gives no rows; a very long text is one set, its
words taken in blocks; ties in rarity go by hash, and a similarity at the threshold links. Columns
besides key and text are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textnum as tn
from .components import components

#: Counters of the sketch, as a power of two: 8 MB to each executor, whatever the input.
SKETCH_BITS = 21
_PART = 1 << 13
#: Lists up to this length are filtered pair by pair; longer ones are tied in a chain.
LIST = 96
#: Occurrences by which a shingle's count must stand out for its list to be dealt over several tasks.
HOT = 1 << 12
#: Marks that a task remembers at most, to give the prefix of a copy but once.
SEEN = 1 << 17
#: Rows of placed documents (32 bytes each) up to which they are broadcast to the texts.
BROADCAST_ROWS = 1 << 20
#: Shingles and sets of a block.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 18, 256
#: Bits of a set's parities, and sets whose parities meet those of a block at once.
PARITY_BITS, PACK_SETS = 1 << 10, 1 << 11


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of so many elements together link: 100 i >= p (total - i)."""
    return -(-percent * total // (100 + percent))


def _sets(batch_text: pa.Array, n: int, table: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    raw, off = tn.utf8(batch_text)
    for i, j in tn.chunks(off):
        words = tn.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], table)
        hashes, doc = words.shingles(n)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        yield i, j, [np.unique(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _mark(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = tn.mix64(x + np.uint64(1)).sum(dtype=np.uint64)
        b = tn.mix64(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def survey(docs: DataFrame, n: int, table: np.ndarray) -> DataFrame:
    """One pass over the texts: a row of key, n_shingles and the halves of the set's mark for each document, and rows of part and counts for a task's own sketch of all shingles."""
    size = 1 << SKETCH_BITS
    names = ["key", "n_shingles", "mark", "mark2", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for i, j, sets in _sets(batch.column("text"), n, table):
                at, times = np.unique(np.concatenate(sets) & np.uint64(size - 1), return_counts=True)
                total[at] += times.astype(np.uint32)
                both, m = [_mark(x) for x in sets], j - i
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, m), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = total.reshape(-1, _PART)
        some = [k for k in range(len(parts)) if parts[k].any()]
        if some:
            kind, m = "<u2" if total.max() < 1 << 16 else "<u4", len(some)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array(some, pa.int32()), pa.array([parts[k].astype(kind).tobytes() for k in some], pa.binary())], names=names)

    return docs.mapInArrow(common.lean(run), "key long, n_shingles long, mark long, mark2 long, part int, counts binary")


def sketch(parts: DataFrame) -> np.ndarray:
    """Counts of shingles by the low bits of their hash, over all documents; each part of the sketch is summed apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(data, dtype="<u2" if len(data) == 2 * _PART else "<u4").astype(np.uint64)
                held[part] = held[part] + got if part in held else got
        if held:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "counts": pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in held.values()], pa.binary())})

    out = np.zeros(((1 << SKETCH_BITS) // _PART, _PART), dtype=np.uint32)
    shards = min(common.partitions(parts.sparkSession), len(out))
    for r in parts.repartition(shards, "part").mapInArrow(common.lean(add), "part int, counts binary").toLocalIterator():  # a row for each part of the sketch
        out[r.part] = np.frombuffer(r.counts, dtype="<u4")
    return out.ravel()


def postings(docs: DataFrame, n: int, percent: int, counts: np.ndarray, table: np.ndarray) -> DataFrame:
    """token, mark, mark2, size and place of the prefix shingles of every set, which each task gives once; salt deals out the lists of shingles that stand out in the sketch, and is 0 otherwise."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    hot = int(2 * counts.mean()) + HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << SKETCH_BITS) - 1)
        counts = sent.value
        rank = np.minimum(counts, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, sets in _sets(batch.column("text"), n, table):
                token, info, place = [], [], []
                if len(seen) > SEEN:
                    seen.clear()
                for x in sets:
                    if not len(x) or (mark := _mark(x)) in seen:
                        continue
                    seen.add(mark)
                    order = rank[x & low] | (x >> np.uint64(20))
                    k = len(x) - -(-percent * len(x) // 100) + 1
                    first = np.argpartition(order, k - 1)[:k] if k < len(x) else np.arange(len(x))
                    first = first[np.lexsort((x[first], order[first]))]
                    token.append(x[first])
                    info.append((*mark, len(x), k))
                    place.append(np.arange(k, dtype=np.int32))
                if not token:
                    continue
                times = [i[3] for i in info]
                columns = [np.repeat(np.array([i[c] for i in info], dtype=np.int64), times) for c in range(3)]
                token = np.concatenate(token)
                often = counts[token & low].astype(np.int64)
                salt = np.where(often >= hot, 1 + (columns[0] >> 7) % (1 + often // HOT), 0)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(np.concatenate(place))], names=["token", "salt", "mark", "mark2", "size", "place"])

    return docs.select("text").mapInArrow(common.lean(run), "token long, salt int, mark long, mark2 long, size int, place int")


def _blocks_of(size: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero((size[1:] != size[:-1]) | (place[1:] != place[:-1])) + 1).tolist(), len(size)]
    return list(zip(cuts, cuts[1:], strict=False))


def tie_list(mark: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of entries that tie together what a list's candidates tie, at most one less than its entries.

    The list is sorted by size and place; entries with both the same are a block, and two blocks
    are skipped where min(place) bounds the overlap below the least.
    """
    n = len(mark)
    if n > LIST:
        return [(i, i + 1) for i in range(n - 1)]
    blocks, out = _blocks_of(size, place), []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, (first, end) in enumerate(blocks):
        for other, stop in blocks[a:]:
            x, y = int(size[first]), int(size[other])
            if 100 * x < percent * y:
                break
            need = -(-percent * (x + y) // (100 + percent))
            if min(x - int(place[first]), y - int(place[other])) < need:
                continue
            for i, j in ((k, first) for k in range(first + 1, end)):
                if find(i) != find(j):
                    root[find(i)] = find(j)
                    out.append((i, j))
            for j in range(other, stop):
                if find(first) != find(j):
                    root[find(j)] = find(first)
                    out.append((first, j))
    return out


def ties(post: DataFrame, percent: int, shards: int) -> DataFrame:
    """Pairs of marks (a, a2, b, b2) that the lists of all shingles tie together.

    A list that was dealt out is tied as a chain in each of its parts, and the parts' first entries to the least of them.
    """
    names = ["hub", "a", "a2", "b", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[tuple[int, int, int, int]] = set()
        heads: list[tuple[int, int, int]] = []
        carry: list[np.ndarray] | None = None

        def out() -> pa.RecordBatch:
            rows = [(None, *m) for m in made] + [(t, m, m2, m, m2) for t, m, m2 in heads]
            made.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=names)

        def tie(now: list[np.ndarray], a: int, b: int, follows: bool) -> None:
            token, salt, mark, mark2, size, place = (c[a:b] for c in now)
            if salt[0] and not follows:
                heads.append((int(token[0]), int(mark[0]), int(mark2[0])))
            pairs = [(i, i + 1) for i in range(b - a - 1)] if salt[0] or follows else tie_list(mark, size, place, percent)
            for i, j in pairs:
                x, y = (int(mark[i]), int(mark2[i])), (int(mark[j]), int(mark2[j]))
                if x != y:
                    made.add((*min(x, y), *max(x, y)))

        follows = False  # whether the first entry of carry stands for the part of a long list that is done
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "mark", "mark2", "size", "place")]
            if carry is not None:
                now = [np.concatenate(pair) for pair in zip(carry, now, strict=True)]
            if not len(now[0]):
                continue
            # Copies of a set, which other tasks posted too, stand side by side and make no list longer.
            other = np.any([c[1:] != c[:-1] for c in now[:4]], axis=0)
            if not other.all():
                now = [c[np.concatenate(([True], other))] for c in now]
            cuts = np.concatenate(([0], np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1, [len(now[0])]))
            whole = np.flatnonzero(np.diff(cuts[:-1]) > 1) if len(cuts) > 2 else []
            salted = np.flatnonzero((np.diff(cuts[:-1]) == 1) & (now[1][cuts[:-2]] > 0)) if len(cuts) > 2 else []
            for k in [*whole, *salted]:
                tie(now, int(cuts[k]), int(cuts[k + 1]), follows and k == 0)
            a = int(cuts[-2])
            follows = follows and a == 0
            if len(now[0]) - a > 4 * LIST:
                tie(now, a, len(now[0]), follows)
                a, follows = len(now[0]) - 1, True
            carry = [c[a:] for c in now]
            if len(made) > 20_000:
                yield out()
        if carry is not None and (len(carry[0]) > 1 or carry[1][0]) and not (follows and len(carry[0]) == 1):
            tie(carry, 0, len(carry[0]), follows)
        if made or heads:
            yield out()

    dealt = post.repartition(shards, "token", "salt").sortWithinPartitions("token", "salt", "size", "place", "mark", "mark2")
    made = dealt.mapInArrow(common.lean(run), "hub long, a long, a2 long, b long, b2 long").distinct()
    return made


def hubs(made: DataFrame) -> DataFrame:
    """The pairs of :func:`ties`, with the parts of each list that was dealt out tied to its least entry."""
    heads = made.filter("hub is not null")
    least = heads.groupBy("hub").agg(F.min(F.struct("a", "a2")).alias("least"))
    joined = heads.select("hub", "b", "b2").join(least, "hub").select(F.col("least.a").alias("a"), F.col("least.a2").alias("a2"), "b", "b2")
    return made.filter("hub is null").select("a", "a2", "b", "b2").unionByName(joined)


class Overlaps:
    """Overlaps of sets: a set's shingles are numbers, and marking one set's numbers counts its overlap with all others in one sweep."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.edge = np.concatenate(([0], np.cumsum(self.size)))
        known, number = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.number, self.mark = number.astype(np.int32), np.zeros(len(known) + 1, dtype=np.int32)

    def row(self, i: int) -> np.ndarray:
        own = self.number[self.edge[i] : self.edge[i + 1]]
        self.mark[own] = 1
        total = np.concatenate(([0], np.cumsum(self.mark[self.number], dtype=np.int32)))
        self.mark[own] = 0
        return (total[self.edge[1:]] - total[self.edge[:-1]]).astype(np.int64)


def link_block(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, group_left: list[int] | None = None, group_right: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one), as pairs of places.

    Sets with counted overlaps serve the others: if A lacks a of B's shingles and B lacks b of A's, then
    |B n C| is |A n C| - b at the least and |A n C| + a at the most, for any C. With groups, pairs
    within a group are left out, as they are connected.
    """
    own = right is None
    both = Overlaps(left if own else left + right)
    n, first = len(both.size), 0 if own else len(left)
    part = np.arange(n) if group_left is None else np.unique([*group_left, *(group_right or [])], return_inverse=True)[1]
    reach = lambda size, inter: 100 * inter >= percent * (size + both.size - inter)
    kept: list[int] = []
    rows = np.zeros((0, n), dtype=np.int64)
    out = []
    for i in range(len(left)):
        open_ = part != part[i]
        open_[: first if not own else i] = False
        if not open_.any():
            continue
        size = both.size[i]
        linked = np.zeros(n, dtype=bool)
        if kept:
            a = int(np.argmax(2 * rows[:, i] - both.size[kept]))  # the one with the fewest shingles that only one of the two has
            row, shared = rows[a], rows[a, i]
            low, high = np.maximum(row - (both.size[kept[a]] - shared), 0), np.minimum(row + size - shared, np.minimum(size, both.size))
            linked = open_ & (low > 0) & reach(size, low)
            unsure = open_ & ~linked & (high > 0) & reach(size, high)
            if linked.any():
                unsure &= ~np.isin(part, part[linked])
        else:
            unsure = open_
        if unsure.any():
            row = both.row(i)
            rows = np.concatenate((rows, row[None]))
            kept.append(i)
            linked = open_ & (row > 0) & reach(size, row)
        for j in np.flatnonzero(linked).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((i, j - first))
    return out


def _unpack(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]


def _link_within(blocks: DataFrame, link: Callable) -> DataFrame:
    """Links within blocks: rows (block, node, hashes), many blocks in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in common.runs(batches, "block"):
            if group.num_rows > 1:
                nodes = group.column("node").to_pylist()
                for i, j in link(_unpack(group), None):
                    a.append(nodes[i])
                    b.append(nodes[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.select("block", "node", "hashes").repartition(common.partitions(blocks.sparkSession), "block").sortWithinPartitions("block").mapInArrow(common.lean(run), "a long, b long")


def _link_between(pairs: DataFrame, link: Callable) -> DataFrame:
    """Links between the two sides of each pair of blocks: rows (pair, side, node, part, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in common.runs(batches, "pair"):
            sides = [group.filter(pa.compute.equal(group.column("side"), s)) for s in (0, 1)]
            if not sides[0].num_rows or not sides[1].num_rows:
                continue
            nodes = [s.column("node").to_pylist() for s in sides]
            parts = [s.column("part").to_pylist() for s in sides]
            for i, j in link(_unpack(sides[0]), _unpack(sides[1]), group_left=parts[0], group_right=parts[1]):
                a.append(nodes[0][i])
                b.append(nodes[1][j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("pair", "side", "node", "part", "hashes").repartition(common.partitions(pairs.sparkSession), "pair").sortWithinPartitions("pair").mapInArrow(common.lean(run), "a long, b long")


def load(docs: DataFrame, placed: DataFrame, n: int, table: np.ndarray) -> DataFrame:
    """The columns of placed and hashes (binary) of its documents; the texts are joined before their words are taken, so no others are."""
    side = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    names = [c for c in placed.columns if c != "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _sets(batch.column("text"), n, table):
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("node", *names)] + [pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", *names, "hashes"])

    return docs.join(side, F.col("key") == F.col("node")).select("text", "node", *names).mapInArrow(common.lean(run), ", ".join(f"{c} long" for c in ("node", *names)) + ", hashes binary").filter("octet_length(hashes) > 0")


def join(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", words: np.ndarray = tn.NON_SPACE) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that links reach) of every row; sets link at 100 |A n B| >= percent |A u B|."""
    spark, shards = docs.sparkSession, common.partitions(docs.sparkSession)
    scratch = common.Scratch(spark, "jaccard")
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    surveyed = scratch.table(survey(own, n, words), "survey")
    marked = surveyed.filter("part is null").drop("part", "counts")
    linkable = marked.filter("n_shingles > 0 and key is not null")
    classes = scratch.table(linkable.groupBy("mark", "mark2").agg(F.min("key").alias("node"), F.max("n_shingles").alias("n_shingles")), "classes")
    counts = sketch(surveyed.filter("part is not null").select("part", "counts"))
    tied = scratch.table(ties(postings(own, n, percent, counts, words), percent, shards), "ties")
    side = lambda m, m2, name: classes.select(F.col("mark").alias(m), F.col("mark2").alias(m2), F.col("node").alias(name))
    candidates = hubs(tied).join(side("a", "a2", "x"), ["a", "a2"]).join(side("b", "b2", "y"), ["b", "b2"]).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    clusters = components(candidates, scratch, "clusters")
    sized = clusters.join(classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")), "node")
    links = cluster_links(sized, lambda placed: load(own, placed, n, words), partial(link_block, percent=percent), scratch, lambda x, y: least_overlap(x + y, percent))
    return reached(marked, classes, links, scratch).select(F.col("key").alias(key), "n_shingles", "component_id")


def reached(marked: DataFrame, classes: DataFrame, links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """key, n_shingles and component_id of every row of marked, by the links between nodes of classes and by equal marks."""
    linkable = marked.filter("n_shingles > 0 and key is not null")
    # A key with several texts stands in several classes; only then do copies join as links too.
    if linkable.select("key", "mark", "mark2").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count():
        links = links.unionByName(linkable.join(classes.drop("n_shingles"), ["mark", "mark2"]).filter("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b")))
        reach = components(links, scratch, "reach")
        out = marked.join(reach, F.col("key") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "key"))
    else:
        reach = components(links, scratch, "reach")
        found = classes.join(reach, "node", "left").select("mark", "mark2", F.coalesce("component", "node").alias("found"))
        some = marked.filter("n_shingles > 0").join(found, ["mark", "mark2"], "left")
        none = marked.filter("n_shingles = 0").withColumn("found", F.col("key"))
        out = some.unionByName(none).withColumn("component_id", F.when(F.col("key").isNotNull(), F.col("found")))
    return out.select("key", "n_shingles", "component_id")


def parities(x: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS classes of elements whether the set has an odd number of them. Each bit in which two sets' parities differ is an element that only one of the sets has."""
    times = np.bincount((tn.mix64(x) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").view("<u8")


def possible(bits: np.ndarray, size: np.ndarray, other_bits: np.ndarray, other_size: np.ndarray, need: Callable) -> np.ndarray:
    """Which sets of one side may share so many elements with which of the other as need says for their sizes, by their parities."""
    out = np.zeros((len(size), len(other_size)), dtype=bool)
    for i, (own, n) in enumerate(zip(bits, size, strict=True)):
        apart = np.bitwise_count(own ^ other_bits).sum(axis=1, dtype=np.int64)
        out[i] = np.minimum(np.minimum(n, other_size), (n + other_size - apart) // 2) >= need(n, other_size)
    return out


def _add_parities(sets: DataFrame) -> DataFrame:
    """node, size and bits of rows of node and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _unpack(batch)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in held], pa.int64()), pa.array([parities(x).tobytes() for x in held], pa.binary())], names=["node", "size", "bits"])

    return sets.select("node", "hashes").mapInArrow(common.lean(run), "node long, size long, bits binary")


def _may_link(pairs: DataFrame, need: Callable) -> DataFrame:
    """Nodes (a, b) of the two sides of each pair of blocks that may link and lie in different parts: rows (pair, side, node, part, size, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.runs(batches, "pair"):
            sides = [group.filter(pa.compute.equal(group.column("side"), s)) for s in (0, 1)]
            if not sides[0].num_rows or not sides[1].num_rows:
                continue
            node, part, size = ([s.column(c).to_numpy() for s in sides] for c in ("node", "part", "size"))
            bits = [np.frombuffer(b"".join(s.column("bits").to_pylist()), dtype="<u8").reshape(s.num_rows, -1) for s in sides]
            i, j = np.nonzero(possible(bits[0], size[0], bits[1], size[1], need) & (part[0][:, None] != part[1]))
            for k in range(0, len(i), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[0][i[k : k + (1 << 16)]]), pa.array(node[1][j[k : k + (1 << 16)]])], names=["a", "b"])

    return pairs.select("pair", "side", "node", "part", "size", "bits").repartition(common.partitions(pairs.sparkSession), "pair").sortWithinPartitions("pair").mapInArrow(common.lean(run), "a long, b long")


def cluster_links(clusters: DataFrame, load: Callable[[DataFrame], DataFrame], link: Callable, scratch: common.Scratch, need: Callable = lambda x, y: 0) -> DataFrame:
    """A spanning forest of all links within the clusters (node, component, n_shingles); load adds hashes to rows with a node, link works as :func:`link_block`, and need gives the least number of hashes that sets of such sizes share if link may join them."""
    # Blocks of near equal cost in order of size: running sums over the sizes of each cluster, and
    # rows of one size spread by hash over the blocks that their cost needs.
    costed = clusters.withColumn("cost", F.greatest(F.col("n_shingles"), F.lit(BLOCK_SHINGLES // BLOCK_SETS)))
    steps = costed.groupBy("component", "n_shingles").agg(F.sum("cost").alias("total"))
    steps = steps.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("component").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = ((F.col("before") + F.pmod(F.xxhash64("node"), F.col("total"))) / BLOCK_SHINGLES).cast("long")
    placed = scratch.table(costed.join(steps, ["component", "n_shingles"]).select("node", "component", number.alias("number"), F.xxhash64("component", number).alias("block")), "placed")
    large = scratch.table(placed.groupBy("component").agg(F.max("number").alias("most")).filter("most > 0").select("component"), "large")
    small = placed.join(large, "component", "left_anti").select("node", "block")
    within = scratch.table(_link_within(load(small), link), "within")
    if not large.limit(1).count():
        return within
    rest = scratch.table(load(placed.join(large, "component").select("node", "component", "number", "block")), "blocks")
    # First round: each block with itself and with its cluster's first.
    known = within.unionByName(scratch.table(_link_within(rest, link), "own"))
    first = rest.filter("number = 0").select("component", "node", "hashes")
    numbers = rest.filter("number > 0").select("component", "number").distinct()
    pair = F.xxhash64("component", "number").alias("pair")
    side = lambda df, k, part="node": df.withColumn("side", F.lit(k)).withColumn("part", F.col(part))
    round1 = side(first.join(numbers, "component").select(pair, "node", "hashes"), 0).unionByName(side(rest.filter("number > 0").select(pair, "node", "hashes"), 1))
    known = known.unionByName(scratch.table(_link_between(round1, link), "first"))
    # Last round: sets outside their cluster's main part, packed into blocks of their own, meet every block of the cluster.
    now = components(known, scratch, "round").select("node", F.col("component").alias("part"))
    state = rest.select("node", "component", "number").join(now, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = state.groupBy("component", "part").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("component").agg(F.max(F.struct("c", "part")).alias("main"))
    state = scratch.table(state.join(main, "component").select("node", "component", "number", "part", (F.col("part") != F.col("main.part")).alias("other")), "state")
    others = state.filter("other")
    if not others.limit(1).count():
        return known
    # Only short marks of all these pairs meet; sets go where a mark leaves a link open, others of one part side by side.
    parts = others.groupBy("component", "part").agg(F.count(F.lit(1)).alias("total"))
    parts = parts.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("component").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("before") + F.pmod(F.xxhash64("node"), F.col("total"))
    packed = scratch.table(others.join(parts, ["component", "part"]).select("node", "component", "part", (at / BLOCK_SETS).cast("long").alias("pack"), (at / PACK_SETS).cast("long").alias("wide")), "packed")
    bits = scratch.table(_add_parities(rest), "parities")
    grid = packed.select("component", "wide").distinct().join(rest.select("component", "number").distinct(), "component")
    pair = F.xxhash64("component", "wide", "number").alias("pair")
    marks = side(packed.join(grid, ["component", "wide"]).select(pair, "node", "part").join(bits, "node"), 0, "part").unionByName(side(state.join(grid, ["component", "number"]).select(pair, "node", "part").join(bits, "node"), 1, "part"))
    open_ = scratch.table(_may_link(marks, need), "open")
    met = open_.join(packed.select(F.col("node").alias("a"), F.col("part").alias("a_part"), "component", "pack"), "a").join(state.select(F.col("node").alias("b"), F.col("part").alias("b_part"), "number"), "b")
    pair = F.xxhash64("component", "pack", "number").alias("pair")
    hashes = rest.select("node", "hashes")
    left = met.select(pair, F.col("a").alias("node"), F.col("a_part").alias("part")).distinct().join(hashes, "node")
    right = met.select(pair, F.col("b").alias("node"), F.col("b_part").alias("part")).distinct().join(hashes, "node")
    round2 = side(left, 0, "part").unionByName(side(right, 1, "part"))
    return known.unionByName(scratch.table(_link_between(round2, link), "last"))
