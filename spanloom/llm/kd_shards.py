"""K-d tree sharding: shards of near equal bytes, alike in size, density and lines.

The rows' metadata (a few numbers each, written once) are split recursively. At each level every
node takes its widest dimension, by its extent against the whole table's, and its weighted median:
the point that gives the left child bytes in proportion to its leaves. Histograms find that point
for all nodes of a level at once, each finer within the bin that the point is in, first along the
dimension, then the texts' checksums, then the rows; what reaches the driver is bounded by nodes
times bins. The order along a cut is (dimension, checksum, row), so equal texts stay together,
except that a group too large to go to one side whole (over GROUP_PART of a shard) is divided.

Law: ``bytes``. Cases: a null text has size 16 and checksum 0; ties and repeated rows are told
apart by row; with fewer rows than shards some shards are empty; an empty table gives no rows; a
very long text counts with all its bytes and may make a shard of its own too large, as rows are not
divided. Columns other than key and text are left out, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A bin in 2**BITS of its node's interval.
BITS = 10
#: Bytes of a shard that a cut may be off its point, and those that it may be off to keep a group of equal texts whole.
NEAR_PART, GROUP_PART = 0.0005, 0.04
_LOW = -(2**63)


@dataclass
class Cut:
    """A node whose cut is being found: fixed leading keys, the interval of the current key, and the weight before it."""

    node: int
    leaves: int
    dim: int
    target: float
    low: int
    high: int
    near: float
    group: float
    keys: list[int] = field(default_factory=list)
    before: float = 0.0
    found: tuple[int, int, int] | None = None

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low + 1 - 1).bit_length() - BITS)

    def tuple_at(self, value: int) -> tuple[int, int, int]:
        return (*self.keys, value, _LOW, _LOW)[:3]

    def refine(self, bins: list[tuple[int, int]], ends: list[tuple[int, int]]) -> None:
        """Takes the weights of the bins in order, and settles on an edge or a finer interval."""
        total, at = self.before, None
        for b, weight in bins:
            edge = self.low + (b << self.shift)
            if total + weight >= self.target or (b, weight) == bins[-1]:
                off, over = self.target - total, total + weight - self.target
                after = edge + (1 << self.shift)
                whole = self.shift == 0
                enough = self.near if not (whole and len(self.keys) == 1) else self.group
                if min(abs(off), abs(over)) <= enough:
                    self.found = self.tuple_at(edge if abs(off) <= abs(over) else after)
                elif not whole:
                    self.low, self.high, self.before = edge, after - 1, total
                elif len(self.keys) < 2:
                    self.keys.append(edge)
                    self.low, self.high, self.before = *ends[len(self.keys) - 1], total
                else:
                    self.found = self.tuple_at(edge if abs(off) <= abs(over) else after)
                return
            total += weight
        self.found = self.tuple_at(self.high + 1 if at is None else at)


def metadata(text: Column) -> list[Column]:
    """The dimensions: bytes, bytes of 1000 characters, lines."""
    size, chars = F.octet_length(text).cast("long"), F.char_length(text).cast("long")
    return [size, F.coalesce((size * 1000 / F.nullif(chars, F.lit(0))).cast("long"), F.lit(0).cast("long")), (chars - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")]


def _less(cuts: DataFrame) -> Column:
    key = [F.element_at("dims", F.col("dim") + 1), F.col("checksum"), F.col("row")]
    v = [F.col("v0"), F.col("v1"), F.col("v2")]
    return (key[0] < v[0]) | (key[0] == v[0]) & ((key[1] < v[1]) | (key[1] == v[1]) & (key[2] < v[2]))


def shards(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; slots count from 0 within a shard, by row, without gaps."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "kd-shards")
    body = F.coalesce(F.col("body"), F.lit(""))
    base = scratch.table(
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("body")).select(
            "key", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("checksum"), F.monotonically_increasing_id().alias("row"), F.array(*metadata(body)).alias("dims"), F.lit(1).cast("long").alias("node")
        ),
        "rows",
    )
    n_dims = 3
    rows, level = base, 0
    leaves = {1: n_shards}  # of the nodes that are still to be split
    numbers: dict[int, tuple[int, int]] = {1: (0, n_shards)}
    root: list[tuple[int, int]] = []
    while leaves:
        state = spark.createDataFrame([(n, k) for n, k in leaves.items()], "node long, leaves int")
        extents = [f(F.element_at("dims", d + 1)).alias(f"{name}{d}") for d in range(n_dims) for f, name in ((F.min, "low"), (F.max, "high"))]
        ends = [f("row").alias(x) for f, x in ((F.min, "row_low"), (F.max, "row_high"))]
        found = rows.join(F.broadcast(state), "node").groupBy("node").agg(F.sum("size").alias("weight"), *extents, *ends).collect()  # a row for each node
        if not root:
            root = [(found[0][f"low{d}"], found[0][f"high{d}"]) for d in range(n_dims)] if found else []
        cuts, limits = [], {}
        for r in found:
            wide = [(r[f"high{d}"] - r[f"low{d}"]) / max(1, root[d][1] - root[d][0]) for d in range(n_dims)]
            dim, k = wide.index(max(wide)), leaves[r.node]
            share = r.weight / k
            cuts.append(Cut(r.node, k, dim, share * (k // 2), r[f"low{dim}"], r[f"high{dim}"], share * NEAR_PART, share * GROUP_PART))
            limits[r.node] = [(0, 2**32 - 1), (r.row_low, r.row_high)]
        while open_ := [c for c in cuts if c.found is None]:
            plan = spark.createDataFrame([(c.node, c.dim, len(c.keys), *(c.keys + [0, 0])[:2], c.low, c.high, c.shift) for c in open_], "node long, dim int, depth int, k0 long, k1 long, low long, high long, shift int")
            value = F.when(F.col("depth") == 0, F.element_at("dims", F.col("dim") + 1)).when(F.col("depth") == 1, F.col("checksum")).otherwise(F.col("row"))
            held = rows.join(F.broadcast(plan), "node").withColumn("value", value)
            held = held.filter("value between low and high").filter((F.col("depth") == 0) | (F.element_at("dims", F.col("dim") + 1) == F.col("k0"))).filter((F.col("depth") < 2) | (F.col("checksum") == F.col("k1")))
            bins: dict[int, list[tuple[int, int]]] = {c.node: [] for c in open_}
            for r in held.groupBy("node", F.call_function("shiftright", F.col("value") - F.col("low"), F.col("shift")).alias("bin")).agg(F.sum("size").alias("weight")).collect():  # nodes x bins
                bins[r.node].append((r.bin, r.weight))
            for c in open_:
                c.refine(sorted(bins[c.node]), limits[c.node])
        table = spark.createDataFrame([(c.node, c.dim, *c.found) for c in cuts], "node long, dim int, v0 long, v1 long, v2 long")
        rows = rows.join(F.broadcast(table), "node", "left").withColumn("node", F.when(F.col("v0").isNull(), F.col("node")).when(_less(table), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)).select(*base.columns)
        level += 1
        rows = scratch.table(rows, f"level{level}")  # one join deep again
        scratch.drop(f"level{level - 1}" if level > 1 else "rows")
        new: dict[int, int] = {}
        for node, k in leaves.items():
            first, _ = numbers.pop(node)
            for child, n in ((2 * node, k // 2), (2 * node + 1, k - k // 2)):
                numbers[child] = (first if child == 2 * node else first + k // 2, n)
                if n > 1:
                    new[child] = n
        leaves = new if found else {}
    if n_shards > 1 and root:
        shard_of = spark.createDataFrame([(n, s) for n, (s, _) in numbers.items()], "node long, shard int")
        rows = rows.join(F.broadcast(shard_of), "node").drop("node")
    else:
        rows = rows.withColumn("shard", F.lit(0)).drop("node")
    placed = scratch.table(rows.select("key", "size", "checksum", "row", "shard"), "placed")
    return _slots(placed).select(F.col("key").alias(key), "size", F.col("checksum").alias("text_crc32"), "shard", "slot")


def _slots(placed: DataFrame) -> DataFrame:
    """Numbers the rows of each shard, as a running start of its buckets plus the place in the bucket; buckets hold about as many rows each."""
    counts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    total = sum(counts.values())
    size = min(100_000, max(200, total // 2000))
    spark = placed.sparkSession
    split = spark.createDataFrame([(s, -(-n // size)) for s, n in counts.items()], "shard int, buckets long")
    rows = placed.join(F.broadcast(split), "shard").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    starts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    if total // size <= 1 << 19:
        starts = F.broadcast(starts)
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
