"""Vectorised text primitives shared by the Python-side operators of this subpackage.

Texts arrive as Arrow string arrays; everything here works on the flat UTF-8 buffer with numpy,
so that no Python object is made per character or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of a Python worker whatever the batch size.
CHUNK_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry table, True for bytes outside the excluded inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: Word classes of the operators, as classes of UTF-8 bytes (all excluded characters are ASCII).
NON_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ALNUM[65:91] = True  # A-Z are folded before words are taken

_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[ascii_lower_table()]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
        step = step * step
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = -(-n // 65_536) * 65_536
                self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_utf8()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, of one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: A-Z in lower case, all other bytes as they are.
_FOLDED = ascii_lower_table()


class Words:
    """Words of a run of texts: start and end byte, 64-bit hash of the folded word, and the range of words of each text; with heads also hashes of the words' beginnings of so many bytes (0 where a word is no longer).

    A hash is that of a word alone, wherever it stands, so a long text is taken in blocks that end between words; what is held by byte is bounded by a block.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, heads: tuple[int, ...] = ()) -> None:
        self.raw, self.offsets = raw, offsets
        parts, at = [], 0
        while at < len(raw) or not parts:
            end = len(raw)
            if end - at > 2 * CHUNK_BYTES:
                gap = np.flatnonzero(~table[raw[at + CHUNK_BYTES : at + 2 * CHUNK_BYTES]])
                if not len(gap):  # a word longer than a block
                    gap = np.flatnonzero(~table[raw[at + CHUNK_BYTES :]])
                end = at + CHUNK_BYTES + int(gap[0]) + 1 if len(gap) else end
            parts.append(self._block(raw[at:end], offsets[(offsets > at) & (offsets < end)] - at, table, heads, at))
            at = end
        self.start, self.end, self.hash, self.heads = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        self.first = np.searchsorted(self.start, offsets)
        self.docs, self.count = len(offsets) - 1, np.diff(self.first)

    @staticmethod
    def _block(raw: np.ndarray, edges: np.ndarray, table: np.ndarray, heads: tuple[int, ...], at: int) -> tuple[np.ndarray, ...]:
        n = len(raw)
        inside = table[raw]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges] = False
        after[edges - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        up, down = _BYTES.get(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[raw] * up[:n], out=total[1:])
            own = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
            begun = np.zeros((len(start), len(heads)), dtype=np.uint64)
            for k, size in enumerate(heads):
                long = end - start > size
                begun[long, k] = mix64((total[start[long] + size] - total[start[long]]) * down[start[long]] + np.uint64(1000 + size))
        return start + at, end + at, own, begun

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)

    def prefix(self) -> np.ndarray:
        """Running sums from which :meth:`window` hashes any range of words."""
        up, _ = _WORDS.get(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        return total

    def window(self, prefix: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [start, start + length)."""
        _, down = _WORDS.get(len(self.hash) + 1)
        with np.errstate(over="ignore"):
            size = np.asarray(length).astype(np.uint64)
            return mix64((prefix[start + length] - prefix[start]) * down[start] + size * np.uint64(_BASE))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each n-word shingle, in order; a text of fewer words has its whole sequence as one, an empty one none."""
        prefix = self.prefix()
        full = np.maximum(self.count - n + 1, 0)
        short = (self.count > 0) & (self.count < n)
        made = np.where(short, 1, full)
        doc = np.repeat(np.arange(self.docs), made)
        begin = np.repeat(self.first[:-1], made) + (np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made))
        length = np.where(short, self.count, n)[doc] if len(doc) else np.zeros(0, np.int64)
        return (self.window(prefix, begin, length) if len(doc) else np.zeros(0, np.uint64)), doc

    def text(self, i: int) -> bytes:
        return _FOLDED[self.raw[self.start[i] : self.end[i]]].tobytes()


class Lookup:
    """Positions of sorted hashes; a bit table turns most others away first."""

    BITS = 20

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        self.bits[(known >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are known, and the place of each of those."""
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(64 - self.BITS)])
        at = np.searchsorted(self.known, hashes[maybe])
        at[at == len(self.known)] = 0
        good = self.known[at] == hashes[maybe]
        return maybe[good], at[good]


def ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array over flat values cut at bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
