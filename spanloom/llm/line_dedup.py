"""Line deduplication with DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned together with document
and position, so that a line that a third of all documents share is dealt over many tasks, and
sorted within; streaming over a partition marks the first occurrence of a hash in each document.
Counting those marks (summed before the shuffle) gives the number of documents of each hash. What
goes back to the documents is a compressed bitmap of lines to keep, never text: words of 64 lines
of which none goes are only counted. The bitmaps are broadcast where their counted size is small.

Cases: a null or empty text is one empty line; each row counts as a document of its own, repeated
rows and repeated ids too; a key of exactly min_docs documents goes; an empty key never repeats with
min_chars of 1 or more; a very long text is one row of as many hashes as it has lines; columns other
than key and text are left out or kept as they are, under any names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "".join(map(chr, range(65, 91)))
#: Repeated hashes up to this number (24 bytes each) are broadcast, and bitmaps of up to so many bytes; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 1 << 25


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; only ASCII letters fold."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hash(key: Column, least: int) -> Column:
    """Two halves; the second is that of the key behind a fixed prefix."""
    return F.when(F.char_length(key) >= least, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b")))


def bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n_dropped and keep of the documents that lose lines: words of 64 lines, each behind the number of words before it that keep all; lines beyond the last word are kept.

    A key of at least min_chars code points that at least min_docs documents hold loses all its
    lines, or with keep_first all but its first by document and position. Rows with the same key
    column and text are told apart by neither and share one bitmap.
    """
    scratch = common.Scratch(docs.sparkSession, "line-dedup")
    shards = common.partitions(docs.sparkSession)
    hashed = scratch.table(
        docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).select(
            "doc", F.xxhash64("body").alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.transform(lines(F.col("body")), lambda x: _hash(line_key(x), min_chars)).alias("hashes")
        ),
        "hashes",
    )
    exploded = hashed.select("doc", "text_hash", "row", F.posexplode("hashes").alias("pos", "h")).filter("h is not null").select("doc", "text_hash", "row", "pos", F.col("h.a").alias("hash"), F.col("h.b").alias("hash2"))
    dealt = exploded.repartitionByRange(shards, "hash", "hash2", "doc", "row").sortWithinPartitions("hash", "hash2", "doc", "row", "pos")
    first = F.row_number().over(Window.partitionBy("hash", "hash2", "doc", "row").orderBy("pos")) == 1
    occurrences = scratch.table(dealt.withColumn("first", first), "occurrences")
    counted = occurrences.filter("first").groupBy("hash", "hash2").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc", "row", "pos")).alias("head"))
    repeated = scratch.table(counted.filter(F.col("docs") >= min_docs), "repeated")
    side = repeated.select("hash", "hash2", *(["head"] if keep_first else []))
    if repeated.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    dropped = occurrences.join(side, ["hash", "hash2"])
    if keep_first:
        dropped = dropped.filter(F.struct("doc", "row", "pos") != F.col("head"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = (
        dropped.select("doc", "text_hash", "row", (F.col("pos") / 64).cast("int").alias("word"), "pos", bit.alias("bit"))
        .repartition(shards, "doc", "text_hash")
        .groupBy("doc", "text_hash", "word")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc", "text_hash")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )
    before = lambda i: F.coalesce(F.get("words", i - 1)["word"], F.lit(-1))
    keep = F.transform("words", lambda x, i: F.struct((x["word"] - before(i) - 1).alias("whole"), F.bitwise_not(x["bits"]).alias("bits")))
    counts = F.aggregate("words", F.lit(0), lambda acc, x: acc + F.bit_count(x["bits"]))
    maps = scratch.table(words.select(F.col("doc").alias(key), "text_hash", counts.cast("long").alias("n_dropped"), keep.alias("keep")), "maps")
    size = maps.agg(F.sum(F.aggregate("keep", F.lit(48).cast("long"), lambda acc, x: acc + 8 * (x["whole"] + 1)))).head()[0] or 0  # as unpacked
    return F.broadcast(maps) if size <= BROADCAST_BYTES else maps


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines whose bit is set in the words of an unpacked bitmap, joined again."""
    stays = lambda line, i: F.coalesce(F.call_function("shiftright", F.get(keep, (i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(True))
    return F.when(keep.isNull(), F.coalesce(text.cast("string"), F.lit(""))).otherwise(F.array_join(F.filter(lines(text), stays), "\n"))


def apply(docs: DataFrame, maps: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str, str] = ("_kept", "_n_lines", "_n_dropped")) -> DataFrame:
    """All columns of docs, and under the three names the text that stays, the number of lines, and that of dropped ones; the names must be new."""
    own, key_, hash_, n, keep = common.fresh(docs, "_own", "_key", "_hash", "_n", "_keep")
    left = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    unpacked = F.flatten(F.transform("keep", lambda x: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["whole"]), F.array(x["bits"]))))
    right = maps.select(F.col(key).alias(key_), F.col("text_hash").alias(hash_), F.col("n_dropped").alias(n), unpacked.alias(keep))
    joined = left.join(right, F.col(key).eqNullSafe(F.col(key_)) & (F.col(own) == F.col(hash_)), "left")
    return joined.select(*docs.columns, kept_lines(F.col(text), F.col(keep)).alias(names[0]), F.size(lines(F.col(text))).cast("long").alias(names[1]), F.coalesce(n, F.lit(0).cast("long")).alias(names[2]))
