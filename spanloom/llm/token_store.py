"""Token-id files with a minimal perfect hash index.

A store is a folder of shards. Shard k has ``k.ids``, the raw little-endian ids of its documents one
after another, and ``k.idx``, a header line of JSON and then the index: the levels of a minimal
perfect hash (bits, as words, and their running counts), and for each slot a fingerprint of the
key, the first id and the number of ids, and last the keys in file order. A lookup finds the shard
by the least and greatest keys in the manifest, hashes the key to its slot, compares the
fingerprint, and reads one slice of the payload: a few reads of single values at computed places,
whatever the number of documents.

Documents are dealt to shards by ranges of (key, hash of the text, row) and sorted within, so
ascending shards hold ascending keys, and rows that share a key can be dealt to more than one shard,
even where they share the text. A task writes files under a name of its own attempt and returns one
manifest row; only files that the manifest names belong to the store, so repeated or lost tasks do
no harm.

Cases: a null or empty text is the end id alone; rows with the same key are stored one after
another, ordered by the text's hash; null keys come first; a very long text is encoded in windows;
a special token's string in a text is that token, as by the library's default; columns other than
key and text are left out, so their names cannot clash. An empty table gives an empty store.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common
from . import textnum as tn

END_ID = 0
_NULL = np.int64(-(2**63))
#: A row for each shard; a null key counts as the least long.
MANIFEST = "shard int, path string, n_docs long, n_ids long, least long, greatest long"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tn.mix64(keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: at each level a key that no other key meets takes its bit, the rest go on to the next."""

    GAMMA, LEVELS = 2, 64

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = -(-len(left) * cls.GAMMA // 64) * 64
            at = (_hash(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    @classmethod
    def probe(cls, sizes: list[int], key: np.uint64) -> Iterator[tuple[int, int]]:
        """The word and the bit within it that each level has for a key."""
        start = 0
        for level, size in enumerate(sizes):
            bit = int(_hash(np.array([key], dtype=np.uint64), level)[0] % np.uint64(size)) + start
            yield bit >> 6, bit & 63
            start += size

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit, which shows that the key is absent."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, inner = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> inner) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << inner[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.before[bit[hit] >> 6] + below
            open_ = open_[~hit]
        return out


def _slot_keys(keys: np.ndarray) -> np.ndarray:
    """Distinct 64-bit keys of sorted document keys: the j-th row of a key is told apart by j."""
    n = len(keys)
    new = np.ones(n, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    turn = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    with np.errstate(over="ignore"):
        return tn.mix64(keys.view(np.uint64)) + turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _fingerprints(slot_keys: np.ndarray) -> np.ndarray:
    return (_hash(slot_keys, 1001) >> np.uint64(32)).astype(np.uint32)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


#: Sections of an index file.
WORDS, BEFORE, FINGERPRINT, FIRST, COUNT, KEYS = range(6)


class Shard:
    """An open shard. Sections are read whole, or a value at a time."""

    def __init__(self, path: str) -> None:
        fs, own = _file_system(path)
        self.file, self.payload = fs.open_input_file(own + ".idx"), fs.open_input_file(own + ".ids")
        head = b""
        while b"\n" not in head:
            head += self.file.read_at(4096, len(head))
        line = head.index(b"\n") + 1
        self.head = json.loads(head[:line])
        self.dtype = np.dtype(self.head["ids"])
        self.sections = []
        for kind, n in self.head["sections"]:
            self.sections.append((np.dtype(kind), n, line))
            line += np.dtype(kind).itemsize * n

    def section(self, k: int) -> np.ndarray:
        kind, n, at = self.sections[k]
        return np.frombuffer(self.file.read_at(kind.itemsize * n, at), dtype=kind)

    def value(self, k: int, i: int) -> np.generic:
        kind, _, at = self.sections[k]
        return np.frombuffer(self.file.read_at(kind.itemsize, at + kind.itemsize * i), dtype=kind)[0]

    def all_slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys in file order and the slot of each, found by the index; a key that the index lacks is an error."""
        keys = self.section(KEYS)
        own = _slot_keys(keys)
        slot = PerfectHash(self.head["levels"], self.section(WORDS)).slots(own)
        if len(slot) and (slot.min() < 0 or not np.array_equal(self.section(FINGERPRINT)[slot], _fingerprints(own))):
            raise ValueError("a key is missing from its index")
        return keys, slot

    def slot(self, own: np.uint64) -> int:
        """The slot of one key, or -1: at most two values are read for each level of the hash, and the fingerprint."""
        for word, bit in PerfectHash.probe(self.head["levels"], own):
            held = int(self.value(WORDS, word))
            if held >> bit & 1:
                slot = int(self.value(BEFORE, word)) + (held & ((1 << bit) - 1)).bit_count()
                return slot if self.value(FINGERPRINT, slot) == _fingerprints(np.array([own], dtype=np.uint64))[0] else -1
        return -1

    def read(self, first: int, count: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at(count * width, first * width), dtype=self.dtype)

    def get(self, key: int, turn: int) -> np.ndarray | None:
        """The ids of the turn-th row of a key in this shard."""
        slot = self.slot(_slot_keys(np.full(turn + 1, key, dtype=np.int64))[-1])
        return None if slot < 0 else self.read(int(self.value(FIRST, slot)), int(self.value(COUNT, slot)))


def _write(path: str, keys: np.ndarray, first: np.ndarray, count: np.ndarray, dtype: str) -> None:
    own = _slot_keys(keys)
    index = PerfectHash.build(own)
    slot = index.slots(own)
    by_slot = np.empty(len(keys), dtype=np.int64)
    by_slot[slot] = np.arange(len(keys))
    parts = [index.words, index.before, _fingerprints(own)[by_slot], first[by_slot], count[by_slot], keys]
    kinds = ["<u8", "<i8", "<u4", "<i8", "<i8", "<i8"]
    head = {"levels": index.sizes, "ids": dtype, "sections": [[k, len(p)] for k, p in zip(kinds, parts, strict=True)]}
    fs, own_path = _file_system(path)
    with fs.open_output_stream(own_path + ".idx") as file:
        file.write(json.dumps(head).encode() + b"\n")
        for kind, part in zip(kinds, parts, strict=True):
            file.write(part.astype(kind).tobytes())


@lru_cache(2)
def _library(path: str, table: bytes) -> tuple[bpe.Encoder, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder()
    if tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("texts would be changed before they are cut")
    n = tokenizer.get_vocab_size()
    size = np.zeros(n, dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token)  # a character stands for a byte
    for i, token in added.items():
        size[i] = len(token.content.encode())

    def ids_of(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The library's vocabulary cuts a text before it merges, so each distinct pre-token needs it once.
        blob = raw.tobytes()
        made = tokenizer.encode([blob[a : a + k].decode() for a, k in zip(start.tolist(), length.tolist(), strict=True)], is_pretokenized=True, add_special_tokens=False)
        return np.array(made.ids, dtype=np.int32), np.bincount(made.word_ids, minlength=len(start))

    long_ids = lambda piece: np.array(tokenizer.encode(piece.tobytes().decode(), add_special_tokens=False).ids, dtype=np.int32)
    return bpe.Encoder(table, size, ids_of, long_ids, {t.content.encode(): i for i, t in added.items()}), n


def write(docs: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the store of ``docs`` into ``folder`` and returns its manifest; nothing is written before the manifest is read, which should happen once (write it to a table).

    The text crosses the network once, to the shard of its key's range; ids never do.
    """
    spark, table = docs.sparkSession, bpe.class_table()
    dealt = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(shards or common.partitions(spark), "key", "tie", "row")
        .sortWithinPartitions("key", "tie")
        .select("key", "text", F.spark_partition_id().alias("shard"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _library(tokenizer_path, table)
        dtype = "<u2" if size <= 1 << 16 else "<u4"
        keys, counts, file, shard, path = [], [], None, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                shard = batch.column("shard")[0].as_py()
                path = f"{folder}/{shard}-{uuid.uuid4().hex}"
                fs, own = _file_system(path)
                file = fs.open_output_stream(own + ".ids")
            keys.append(batch.column("key").fill_null(_NULL).to_numpy(zero_copy_only=False))
            raw, off = tn.utf8(batch.column("text"))
            for i, j in tn.chunks(off):
                ids, _, cut = encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                out = np.insert(ids.astype(dtype), cut[1:], END_ID)
                counts.append(np.diff(cut) + 1)
                file.write(out.tobytes())
        if file is None:
            return
        file.close()
        key_of, count = np.concatenate(keys).astype(np.int64), np.concatenate(counts).astype(np.int64)
        _write(path, key_of, np.cumsum(count) - count, count, dtype)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(count)], "n_ids": [int(count.sum())], "least": [int(key_of[0])], "greatest": [int(key_of[-1])]})

    return dealt.mapInArrow(run, MANIFEST)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, read back through the index.

    The manifest has a row for each shard; the running start of the shards is all that the driver holds.
    """
    rows, base = [], 0
    for r in manifest.orderBy("shard").collect():
        rows.append((r.path, base))
        base += r.n_ids
    plan = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                stored, slot = shard.all_slots()
                first, count = shard.section(FIRST)[slot], shard.section(COUNT)[slot]
                for i, j in tn.chunks(np.concatenate(([0], np.cumsum(count))), tn.CHUNK_BYTES // 4):
                    ids = shard.read(int(first[i]), int(first[j - 1] + count[j - 1] - first[i])).astype("<u4")
                    at = first[i:j] - first[i]
                    sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), count[i:j].tolist(), strict=True)]
                    keys = pa.array(stored[i:j], mask=stored[i:j] == _NULL)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(first[i:j] + base), pa.array(count[i:j]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few keys, on the driver: only shards whose keys can be the wanted one are opened, and of those only single values and the slice are read."""
    rows = manifest.orderBy("shard").collect()  # a row for each shard
    greatest, out, open_ = [r.greatest for r in rows], {}, {}
    for key in map(int, keys):
        out[key] = []
        for r in rows[bisect.bisect_left(greatest, key) :]:
            if r.least > key:
                break
            if r.path not in open_:
                open_[r.path] = Shard(r.path)
            shard = open_[r.path]
            turn = 0
            while (found := shard.get(key, turn)) is not None:
                out[key].append(found)
                turn += 1
    return out
