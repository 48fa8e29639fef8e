"""Subword pieces by the longest match over a double-array trie, their counts, and windows of ids with special tokens.

Words are cut by Spark's expressions; a batch's distinct words are then cut into pieces side by side,
one character of all words at a time. The trie is made once, on the driver, and broadcast: its size is
the vocabulary's.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming import incremental
from . import sequences

PAD, UNKNOWN, FIRST, LAST = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
GOES_ON = "##"
#: Words of more characters are unknown as wholes.
LONGEST = 100


def read_vocabulary(path: str) -> dict[str, int]:
    """A vocabulary of a piece a line, numbered by lines."""
    with open(path, encoding="utf-8") as f:
        return {line.rstrip("\n"): k for k, line in enumerate(f)}


def vocabulary_of_words(path: str, end: str = "</w>") -> dict[str, int]:
    """A vocabulary from a file of byte-level pieces that mark a word's end: each text once as a word's beginning and once as going on."""
    with open(path, encoding="utf-8") as f:
        named = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others come behind 256 in order
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    out = {PAD: 0, UNKNOWN: 1, FIRST: 2, LAST: 3}
    for piece in sorted(named, key=named.get):
        body = piece.removesuffix(end)
        try:
            made = bytes(byte[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):  # a special token, or part of a character
            continue
        for one in (made, GOES_ON + made):
            if made and one not in out:
                out[one] = len(out)
    return out


class Trie:
    """A double array over the pieces: state s goes on by code c to base[s] + c, if that cell's check is s. Code 1 leads to the pieces that go on."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        chars = sorted({c for piece in vocabulary for c in piece})
        self.points, self.unknown = np.array([ord(c) for c in chars], dtype=np.uint32), vocabulary[UNKNOWN]
        code = {c: k + 2 for k, c in enumerate(chars)}
        tree: dict[int, dict] = {}
        for piece, number in vocabulary.items():
            keys = [1, *(code[c] for c in piece[len(GOES_ON) :])] if piece.startswith(GOES_ON) and len(piece) > len(GOES_ON) else [code[c] for c in piece]
            node = tree
            for k in keys:
                node = node.setdefault(k, {})
            node[0] = number  # no character has code 0
        base, check, value = [0], [-1], [-1]
        size, lowest, todo = 1, 1, [(0, tree)]
        while todo:
            state, node = todo.pop()
            keys = sorted(k for k in node if k)
            value[state] = node.get(0, -1)
            if not keys:
                continue
            while lowest < size and check[lowest] >= 0:
                lowest += 1
            at = max(lowest, keys[0])
            while any(at - keys[0] + k < size and check[at - keys[0] + k] >= 0 for k in keys):
                at += 1
            base[state] = at - keys[0]
            need = base[state] + keys[-1] + 1
            if need > size:
                base += [0] * (need - size)
                check += [-1] * (need - size)
                value += [-1] * (need - size)
                size = need
            for k in keys:
                check[base[state] + k] = state
                todo.append((base[state] + k, node[k]))
        room = len(chars) + 2  # no step leads out of the arrays
        self.base = np.array(base + [0] * room, dtype=np.int32)
        self.check = np.array(check + [-1] * room, dtype=np.int32)
        self.value = np.array(value + [-1] * room, dtype=np.int32)
        self.goes_on = self.base[0] + 1 if self.check[self.base[0] + 1] == 0 else -1

    def pieces(self, points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words' pieces, and how many each word has; the words are points[edge[k] : edge[k + 1]]."""
        place = np.minimum(np.searchsorted(self.points, points), max(len(self.points) - 1, 0))
        codes = np.where(self.points[place] == points, place + 2, 0)
        start, end = edge[:-1].copy(), edge[1:]
        failed = (end - start > LONGEST) | (end == start)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(~failed)
        while len(live):
            state = np.full(len(live), self.goes_on if found else 0, dtype=np.int64)
            at, best, stop = start[live], np.full(len(live), -1, dtype=np.int64), start[live]
            walk = np.arange(len(live)) if self.goes_on >= 0 or not found else np.arange(0)
            while len(walk):
                walk = walk[at[walk] < end[live[walk]]]
                code = codes[at[walk]]
                after = self.base[state[walk]] + code
                good = (code > 0) & (self.check[after] == state[walk])
                walk, after = walk[good], after[good]
                state[walk] = after
                at[walk] += 1
                number = self.value[after]
                ends = number >= 0
                best[walk[ends]], stop[walk[ends]] = number[ends], at[walk[ends]]
            cut = best < 0
            failed[live[cut]] = True
            found.append((live[~cut], best[~cut]))
            start[live] = stop
            live = live[~cut & (stop < end[live])]
        word = np.concatenate([f[0] for f in found] + [np.flatnonzero(failed)])
        number = np.concatenate([f[1] for f in found] + [np.full(int(failed.sum()), self.unknown)])
        kept = ~failed[word]
        kept[len(kept) - int(failed.sum()) :] = True
        word, number = word[kept], number[kept]
        return number[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(edge) - 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and their marks, and each other visible character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U:[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}\p{C}]))"), 1)


def _encode(trie: Trie, column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, [])
    times = np.diff(np.asarray(column.offsets)).astype(np.int64)  # flatten() takes only the words of a slice
    coded = column.flatten().dictionary_encode()
    held = coded.dictionary.to_pylist()
    edge = np.concatenate(([0], np.cumsum([len(w) for w in held]))).astype(np.int64)
    ids, count = trie.pieces(np.frombuffer("".join(held).encode("utf-32-le"), dtype=np.uint32), edge)
    word = coded.indices.to_numpy().astype(np.int64)
    each, first = count[word], (np.cumsum(count) - count)[word]
    at = np.arange(int(each.sum())) + np.repeat(first - (np.cumsum(each) - each), each)
    row = np.repeat(np.arange(len(times)), times)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, weights=each, minlength=len(times))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids[at].astype(np.int32)))


#: Words of a slice of rows that is encoded at once: a word takes about 100 bytes meanwhile.
SLICE = 1 << 18


def _sliced(trie: Trie, column: pa.Array) -> pa.Array:
    """The same a slice of rows at a time, so that what is held beside the words and their ids does not grow with the batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    parts, at = [], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE, side="right")) - 1)
        parts.append(_encode(trie, column.slice(at, end - at)))
        at = end
    return pa.concat_arrays(parts) if parts else _encode(trie, column)


def encoder(spark: SparkSession, vocabulary: dict[str, int]):
    """A function from a text column to the ids of its pieces; a null text has none."""
    sent = spark.sparkContext.broadcast(Trie(vocabulary))

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return _sliced(sent.value, column)

    return lambda text: ids(words(text))


def cached_lengths(texts: DataFrame, folder: str, encode, text: str = "text") -> DataFrame:
    """The rows of texts with n_subwords. Counts are kept in a table by the text's hash, and only texts that it lacks are cut into pieces."""
    spark, rows = texts.sparkSession, f"{folder.rstrip('/')}-rows-{uuid.uuid4().hex}"
    keyed = texts.withColumn("_key", F.sha2(F.col(text), 256))
    # Written once, as the texts are read to be cut and their keys to be met; what made them would be run each time.
    keyed.write.parquet(rows)
    held = spark.read.schema(keyed.schema).parquet(rows)
    work = lambda todo: todo.select("key", F.size(encode(F.col("body"))).alias("n_subwords"))
    incremental.append_missing(held.filter(F.col(text).isNotNull()).select(F.col("_key").alias("key"), F.col(text).alias("body")), folder, "key", work)
    known = spark.read.parquet(folder).groupBy(F.col("key").alias("_key")).agg(F.max("n_subwords").alias("n_subwords"))
    return held.join(known, "_key", "left").drop("_key")


def id_windows(ids: Column, first: int, last: int, size: int = 510, overlap: int = 128) -> Column:
    """Overlapping windows of ids, each between a first and a last special token."""
    cut = lambda w, x: F.concat(F.array(F.lit(first)), F.slice(x, (w["first"] + 1).cast("int"), (w["last"] - w["first"]).cast("int")), F.array(F.lit(last)))
    return T.let(ids, lambda x: F.transform(sequences.windows(F.size(x).cast("long"), size, overlap), lambda w: cut(w, x)))


def padded(windows: Column, pad: int, length: Column | None = None) -> Column:
    """Windows as structs of ids, padded to a length (or that of the longest), and mask, 1 where a token stands."""

    def of(w: Column) -> Column:
        to = length if length is not None else F.array_max(F.transform(w, lambda x: F.size(x)))
        return F.transform(w, lambda x: F.struct(F.concat(x, F.array_repeat(F.lit(pad), to - F.size(x))).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), to - F.size(x))).alias("mask")))

    return T.let(windows, of)
