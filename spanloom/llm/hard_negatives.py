"""Hard negatives by blocked dense matrix products.

Vectors are scaled and floored to integers, so that a float64 product is exact below 2**53. Anchors
are dealt into blocks of a fixed size; a block is broadcast and multiplied with every block of
candidates, which are dealt over all tasks whatever their labels. The first pass keeps each
anchor's best positives: a task keeps a running list for each anchor of the block, and the lists
are merged by anchor. They set the windows of scores in which the second pass keeps the best
negatives in the same way. A task holds a block of anchors, its lists and one tile of scores; no
pair is made into a row unless a task's list still holds it at the end.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part; rows
that share an id are one row, the least by label and vector; vectors of different lengths count as
if the shorter ended in zeros, and an empty one scores 0; ties in score go by the smaller id; an
anchor without positives, or a positive without negatives in its window, gives no row; an empty
table gives an empty result. Scores from 2**53 on are put together from halves of the components,
and a table whose scores need not fit a long is refused. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a block of anchors as float64, at about: what a pass broadcasts and the driver holds.
BLOCK_BYTES = 1 << 23
#: Scores of a tile.
TILE = 1 << 20
#: From this product of norms on, scores need halves; from LARGEST on they are refused.
EXACT, LARGEST = float(1 << 52), float(1 << 62)
_HALF = 15
_OUT = "anchor_id long, place int, id long, score long"


class Best:
    """The k best (score, then smaller id) of each row so far; candidates must come in ascending order of id."""

    def __init__(self, rows: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = floor.copy()  # what a new score must exceed

    def add(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ident = np.concatenate((self.row, row)), np.concatenate((self.score, score)), np.concatenate((self.id, ident))
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        start = np.concatenate(([0], np.flatnonzero(row[1:] != row[:-1]) + 1))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate((start, [len(row)]))))
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], ident[kept]
        last = place == self.k - 1
        self.least[row[last]] = score[last]


class Products:
    """Integer inner products of anchors with candidates; wide components are multiplied by halves."""

    def __init__(self, anchors: np.ndarray, wide: bool) -> None:
        self.wide = wide
        self.parts = self._split(anchors)

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        if not self.wide:
            return [np.ascontiguousarray(x)]
        high = np.floor(x / (1 << _HALF))
        return [high, x - high * (1 << _HALF)]

    def __call__(self, rows: slice | np.ndarray, candidates: np.ndarray) -> np.ndarray:
        a, b = [x[rows] for x in self.parts], self._split(candidates)
        if not self.wide:
            return a[0] @ b[0].T
        whole = lambda x, y: (x @ y.T).astype(np.int64)
        return (whole(a[0], b[0]) << 2 * _HALF) + ((whole(a[0], b[1]) + whole(a[1], b[0])) << _HALF) + whole(a[1], b[1])


def _matrix(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """Rows of floor(scale * x), with zeros behind shorter vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _tiles(batches: Iterator[pa.RecordBatch], scale: float, width: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """id, label and components of the candidates, as many at once as a tile of scores with that many anchors takes."""
    step = max(16, TILE // max(rows, 1))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vec"), scale, width)


def _rows(found: list[tuple[int, Best]], ids: np.ndarray) -> pa.RecordBatch:
    columns = [np.concatenate([b.row for _, b in found]), np.concatenate([np.full(len(b.row), j) for j, b in found]), np.concatenate([b.id for _, b in found]), np.concatenate([b.score for _, b in found])]
    return pa.RecordBatch.from_arrays([pa.array(ids[columns[0]]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2]), pa.array(columns[3])], names=["anchor_id", "place", "id", "score"])


def _positives(rows: DataFrame, sent: Broadcast, scale: float, width: int, k: int, wide: bool) -> DataFrame:
    """sent: a block of anchors in order of label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vec = (sent.value[c] for c in ("id", "label", "vec"))
        product = Products(vec, wide)
        best = Best(len(ids), k, np.full(len(ids), np.iinfo(np.int64).min))
        for ident, label, x in _tiles(batches, scale, width, len(ids)):
            for own in np.unique(label):
                a, b = np.searchsorted(labels, own, side="left"), np.searchsorted(labels, own, side="right")
                if a < b:
                    at = np.flatnonzero(label == own)
                    score = product(slice(a, b), x[at])
                    row, col = np.nonzero(score > best.least[a:b, None])
                    other = ids[a + row] != ident[at[col]]
                    row, col = row[other], col[other]
                    best.add(a + row, score[row, col].astype(np.int64), ident[at[col]])
        if len(best.row):
            yield _rows([(0, best)], ids)

    return rows.select("id", "label", "vec").mapInArrow(run, _OUT)


def _negatives(rows: DataFrame, sent: Broadcast, windows: Broadcast, scale: float, width: int, k: int, wide: bool) -> DataFrame:
    """windows: whether an anchor has a positive in that place, and the least and the largest score of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vec = (sent.value[c] for c in ("id", "label", "vec"))
        some, low, high = windows.value
        product = Products(vec, wide)
        best = [(j, Best(len(ids), k, low[:, j] - 1)) for j in range(some.shape[1])]
        for ident, label, x in _tiles(batches, scale, width, len(ids)):
            score = product(slice(None), x)
            other = labels[:, None] != label[None, :]
            for j, b in best:
                row, col = np.nonzero((score > b.least[:, None]) & (score <= high[:, j, None]) & other & some[:, j, None])
                b.add(row, score[row, col].astype(np.int64), ident[col])
        if any(len(b.row) for _, b in best):
            yield _rows(best, ids)

    return rows.select("id", "label", "vec").mapInArrow(run, _OUT)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and place over all tasks; a window limit keeps k a task before the shuffle."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its best positives (other rows of its label), the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    anchor says which rows are anchors, as a column over rows.
    """
    spark, shards = rows.sparkSession, common.partitions(rows.sparkSession)
    scratch = common.Scratch(spark, "hard-negatives")
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    one = own.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("row")).select("id", "row.*")
    dealt = scratch.table(one.repartition(shards, "id").sortWithinPartitions("id"), "rows")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale), F.lit(2.0))))
    facts = dealt.agg(F.count_if("anchor").alias("anchors"), F.max(F.size("vec")).alias("width"), F.max(norm).alias("norm")).head()
    width = max(1, facts["width"] or 1)
    reach = (facts["norm"] or 0.0) ** 2
    if reach >= LARGEST:
        raise ValueError("scores do not fit a long")
    wide = reach >= EXACT
    blocks = -(-facts["anchors"] * (8 * width + 16) // BLOCK_BYTES)
    out = []
    for k in range(blocks):
        held = dealt.filter(F.col("anchor") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)).select("id", "label", "vec").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        order = np.lexsort((held.column("id").to_numpy(), held.column("label").to_numpy()))
        block = {"id": held.column("id").to_numpy()[order], "label": held.column("label").to_numpy()[order], "vec": _matrix(held.column("vec"), scale, width)[order]}
        sent = spark.sparkContext.broadcast(block)
        first = scratch.table(_best(_positives(dealt, sent, scale, width, positives, wide), positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score")), f"positives-{k}")
        got = first.toArrow()  # positives rows an anchor of the block at most
        at = {a: i for i, a in enumerate(block["id"].tolist())}
        row = np.array([at[a] for a in got.column("anchor_id").to_pylist()], dtype=np.int64)
        place, score = got.column("place").to_numpy().astype(np.int64) - 1, got.column("positive_score").to_numpy()
        windows = np.zeros((len(at), positives), dtype=bool)
        lows, highs = np.zeros(windows.shape, dtype=np.int64), np.zeros(windows.shape, dtype=np.int64)
        windows[row, place] = True
        # Floors of shares of 100, without products that leave a long.
        whole, rest = np.divmod(score, 100)
        lows[row, place] = low * whole - (-low * rest // 100)
        highs[row, place] = high * whole + high * rest // 100
        limits = spark.sparkContext.broadcast((windows, lows, highs))
        found = _best(_negatives(dealt, sent, limits, scale, width, negatives, wide), negatives)
        joined = found.withColumn("place", F.col("place") + 1).join(first, ["anchor_id", "place"])
        scratch.table(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"mined/block={k}")
        sent.destroy()
        limits.destroy()
        out.append(k)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not out:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{scratch.root}/mined").drop("block")
