"""Connected components of an edge table, without the driver or one task ever holding more than a block of the graph.

Edges are first contracted by blocks of bounded size: a task ties all nodes of its block that are
connected within it to the least of them. A graph of one block is done then; the blocks of a larger
one are joined by alternating steps on edges (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014):
a large-star ties each node's larger neighbours to its smallest one, a small-star its smaller ones,
until every edge joins a node with its component's smallest. A hub's neighbours are only summed
(a minimum, with map-side partial sums) and joined, never listed in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of a block: 16 bytes each, and some 60 more while it is contracted.
BLOCK = 1 << 18


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that edges connect to a lesser one, and the least of these."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, least = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while True:
        p, q = least[x], least[y]
        if (p == q).all():
            moved = np.flatnonzero(least != np.arange(len(nodes)))
            return nodes[moved], nodes[least[moved]]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while True:
            onward = least[least]
            if (onward == least).all():
                break
            least = onward


def _contract(edges: DataFrame, blocks: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            node, least = contracted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["b", "a"])

        n = 0
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                if n + part.num_rows > size and held:
                    yield done()
                    n = 0
                held.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
                n += part.num_rows
        if held:
            yield done()

    return edges.select("a", "b").coalesce(blocks).mapInArrow(common.lean(run), "b long, a long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: common.Scratch, name: str, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node that an edge (a, b) of longs touches."""
    name = f"{name}-{uuid.uuid4().hex[:8]}"
    whole = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")), f"{name}-whole")
    n, size = whole.count(), BLOCK
    now = scratch.table(_contract(whole, max(1, -(-n // size)), size), f"{name}-0")
    scratch.drop(f"{name}-whole")
    return _stars(now if n <= size else _settled(now, scratch, name, rounds))


def _stars(forest: DataFrame) -> DataFrame:
    return forest.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(forest.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _settled(now: DataFrame, scratch: common.Scratch, name: str, rounds: int) -> DataFrame:
    """The edges (a, b) as stars around the least node of each component."""
    old = None
    for k in range(1, rounds + 1):
        new = scratch.table(_small_star(_large_star(now)), f"{name}-{k}")
        # Both tables are sets of (a, b) with a < b; a star forest is the fixed point.
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        scratch.drop(f"{name}-{k - 1}")
        now = new
        if mark == old:
            return now
        old = mark
    raise RuntimeError("components did not settle")
