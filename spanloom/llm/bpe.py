"""Byte-level BPE encoding and decoding.

Pre-tokens are found without regular expressions. Each code point becomes a symbol of a small
alphabet (its Unicode class, with one code point of look-ahead folded in), and a finite-state
transducer over that alphabet marks the first code point of each pre-token. The transducer runs as
a data-parallel scan: the text is cut into lanes, every lane composes its transition functions
(composition is associative), a prefix scan over the lanes' functions yields each lane's entry
state, and a second sweep over all lanes at once writes the marks.

Pre-tokens are numbered by 128-bit keys of their bytes, all of a slice at once, against a cache of
bounded bytes. Those that the cache lacks are merged side by side: each step joins the adjacent pair
of lowest rank of every piece. Decoding gathers the tokens' bytes; ids, their offsets and the text
are compared on the way.

Cases: a null or empty text has no ids and decodes to no bytes; a repeated row is encoded again;
an empty table gives no rows; equal ranks do not occur, and of equal pairs the leftmost is joined
first; a very long text, with white space or without, goes through in windows of bounded size that
hand the scan's state on (only a single pre-token is ever held whole); columns other than the key
and the text are left out, so their names cannot clash.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textnum as tn

# Symbols: the space and another white space as last of their run, letters, letters that end a
# one-letter contraction or begin a two-letter one, numbers, others, the apostrophe, and white
# space that more white space or the end follows. From RESET on, the same at the start of a text.
SPACE, BLANK, LETTER, SHORT, LONG, NUMBER, OTHER, QUOTE, RUN, RESET = range(10)
# States: start of a text or after BLANK, after SPACE, in letters, numbers, others, after a quote
# that begins a token, within and after a contraction, in a run of white space.
BEGIN, SPACED, LETTERS, NUMBERS, OTHERS, QUOTED, HALF, DONE, BLANKS = range(9)
N_STATES = 9
#: Bytes that the cache of merges may take; beyond that it forgets the pieces used least, which costs time, not results.
CACHE_BYTES = 1 << 24
#: Longer pieces are merged one by one and not kept.
LONG_BYTES = 256
#: The rank of a pair that no token stands for.
NONE = np.int32(2**31 - 1)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables, indexed by symbol * N_STATES + state."""
    to = np.zeros((2 * RESET, N_STATES), dtype=np.uint8)
    out = np.zeros((2 * RESET, N_STATES), dtype=bool)
    letters = (LETTER, SHORT, LONG)
    for state in range(N_STATES):
        for symbol in range(RESET):
            if symbol == SPACE:
                step = SPACED, True
            elif symbol == BLANK:
                step = BEGIN, True
            elif symbol == RUN:
                step = BLANKS, state != BLANKS
            elif state == QUOTED and symbol in (SHORT, LONG):
                step = (DONE if symbol == SHORT else HALF), False
            elif state == HALF and symbol in letters:
                step = DONE, False
            elif symbol in letters:
                step = LETTERS, state not in (SPACED, LETTERS)
            elif symbol == NUMBER:
                step = NUMBERS, state not in (SPACED, NUMBERS)
            else:
                inside = state in (SPACED, OTHERS, QUOTED)
                step = (QUOTED if symbol == QUOTE and not inside else OTHERS), not inside
            to[symbol, state], out[symbol, state] = step
    to[RESET:], out[RESET:] = to[:RESET, BEGIN : BEGIN + 1], True
    return to.ravel(), out.ravel()


_TO, _OUT = _machine()


@lru_cache(1)
def class_table() -> bytes:
    """The symbol of every code point, before look-ahead, compressed.

    Classes come from the Unicode database of the tokenizer library itself, asked once with
    patterns of one character, as Python's own may be older.
    """
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        own = tiktoken.Encoding(f"class{symbol}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(own.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = symbol
    for c in "stmd":
        table[ord(c)] = SHORT
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    return zlib.compress(table.tobytes())


class Boundaries:
    """Finds the pre-tokens of a run of texts."""

    def __init__(self, table: bytes) -> None:
        self.table = np.frombuffer(zlib.decompress(table), dtype=np.uint8)

    def symbols(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols of the code points; a text begins at each of first, and at 0 at the latest."""
        symbol = self.table[points]
        blank = symbol <= BLANK
        ahead = np.ones(len(points), dtype=bool)
        ahead[:-1] = blank[1:]
        inner = first[first > 0]
        ahead[inner - 1] = True
        pair = np.zeros(len(points), dtype=bool)
        pair[:-1] = (points[1:] == ord("e")) & ((points[:-1] == ord("r")) | (points[:-1] == ord("v"))) | (points[1:] == ord("l")) & (points[:-1] == ord("l"))
        pair[inner - 1] = False
        symbol[pair] = LONG
        symbol[blank & ahead] = RUN
        symbol[first] += RESET
        return symbol

    @staticmethod
    def scan(symbol: np.ndarray, enter: int = BEGIN, steps: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the first code point of each pre-token, and the state before each code point."""
        n = len(symbol)
        lanes = -(-n // steps)
        grid = np.full(lanes * steps, RUN, dtype=np.uint8)
        grid[:n] = symbol
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T) * np.uint8(N_STATES)
        run = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], lanes, axis=1)
        for row in grid:  # the function of each lane: entry state -> exit state
            run = _TO[row + run]
            if len(run) > 1 and (run == run[0]).all():
                run = run[:1]  # every entry state leads here
        exits = np.broadcast_to(run, (N_STATES, lanes)).copy()
        reach = 1
        while reach < lanes:  # prefix scan: exits[:, i] becomes the function of lanes 0..i
            exits[:, reach:] = np.take_along_axis(exits[:, reach:], exits[:, :-reach].astype(np.intp), axis=0)
            if len(run) == 1:
                break  # constant functions: one composition settles all
            reach *= 2
        state = np.empty(lanes, dtype=np.uint8)
        state[0] = enter
        state[1:] = exits[enter, :-1]
        marks, before = np.empty(grid.shape, dtype=bool), np.empty(grid.shape, dtype=np.uint8)
        for row, mark, held in zip(grid, marks, before, strict=True):
            held[:] = state
            at = row + state
            mark[:] = _OUT[at]
            state = _TO[at]
        return marks.T.ravel()[:n], before.T.ravel()[:n]

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of all pre-tokens, with the end as a last one, and the first pre-token of each text."""
        if not len(raw):
            return np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(at, np.unique(offsets[:-1][np.diff(offsets) > 0]))
        start = at[self.scan(self.symbols(points, first))[0]]
        return np.append(start, len(raw)), np.searchsorted(start, offsets)

    def windows(self, raw: np.ndarray, limit: int) -> Iterator[np.ndarray]:
        """The pre-tokens of one long text, window after window: offsets of those that end in a window, with the end as a last one.

        A code point's symbol looks one further, so all marks but a window's last are settled. The next window begins at the last such mark, in the state that the scan has there.
        """
        begin, state, size = 0, BEGIN, limit
        while begin < len(raw):
            end = min(len(raw), begin + size)
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            part = raw[begin:end]
            points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            at = np.flatnonzero((part & 0xC0) != 0x80)
            marks, before = self.scan(self.symbols(points, np.zeros(1 if not begin else 0, dtype=np.int64)), state)
            found = np.flatnonzero(marks)
            if end == len(raw):
                yield np.append(at[found], len(part)) + begin
                return
            found = found[found < len(points) - 1]
            if len(found) < 2:  # a pre-token longer than the window
                size *= 2
                continue
            yield at[found] + begin
            state, begin, size = int(before[found[-1]]), begin + int(at[found[-1]]), limit


class Slots:
    """An open hash table from keys of two 64-bit halves to places in arrays; all lookups and insertions of a call run side by side."""

    def __init__(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, a: np.ndarray, b: np.ndarray | None, known_a: np.ndarray, known_b: np.ndarray | None) -> np.ndarray:
        """The place of each key, or -1."""
        at = (a >> self.shift).astype(np.int64)
        out = self.slot[at]
        wrong = out >= 0
        wrong[wrong] = known_a[out[wrong]] != a[wrong]
        if b is not None:
            same = (out >= 0) & ~wrong
            wrong[same] = known_b[out[same]] != b[same]
        open_ = np.flatnonzero(wrong)
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slot[at[open_]]
            out[open_] = got
            held = got >= 0
            open_, got = open_[held], got[held]
            same = known_a[got] == a[open_]
            if b is not None:
                same &= known_b[got] == b[open_]
            open_ = open_[~same]
        return out

    def add(self, a: np.ndarray, place: np.ndarray) -> None:
        """Enters distinct keys that are not there yet."""
        at, left = (a >> self.shift).astype(np.int64), np.arange(len(a))
        place = place.astype(np.int32)
        while len(left):
            spot = at[left]
            free = self.slot[spot] < 0
            self.slot[spot[free]] = place[left[free]]
            left = left[self.slot[spot] != place[left]]
            at[left] = (at[left] + 1) & self.mask


class Vocabulary:
    """The tokens of a rank file as arrays: bytes of every id, and the rank and id of every pair of ids that joins to a token."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[tuple[int, int], tuple[int, int]] | None = None) -> None:
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.ranks = ranks
        self.size = np.array(list(map(len, tokens)), dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        if pairs is None:  # every way to cut a token into two tokens
            get = ranks.get
            pairs = {(x, y): (r, r) for token, r in ranks.items() for k in range(1, len(token)) if (x := get(token[:k])) is not None and (y := get(token[k:])) is not None}
        self.left = np.array([x for x, _ in pairs], dtype=np.uint64) << np.uint64(32) | np.array([y for _, y in pairs], dtype=np.uint64)
        self.rank = np.array([r for r, _ in pairs.values()], dtype=np.int32)
        self.made = np.zeros(int(self.rank.max(initial=0)) + 1, dtype=np.int32)  # by rank
        self.made[self.rank] = [m for _, m in pairs.values()]
        self.known = tn.mix64(self.left)
        self.slots = Slots(max(4, (3 * len(pairs)).bit_length()))
        self.slots.add(self.known, np.arange(len(pairs)))

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        at = self.slots.find(tn.mix64(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)), None, self.known, None)
        return np.where(at >= 0, self.rank[at], NONE)

    def merge(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of raw, end to end, and their numbers: the lowest pair of each piece is joined, the leftmost of equals, until none is left."""
        m = len(start)
        if not m:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own = np.repeat(np.arange(m), size)
        symbol = self.single[raw[_spread(start, size)]]
        rank = np.full(len(symbol), NONE, dtype=np.int32)
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self.join(symbol[inner], symbol[inner + 1])
        out, owners = [], []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            least = np.minimum.reduceat(rank, first)
            number = np.diff(np.append(first, len(own)))
            if (over := least == NONE).any():
                gone = np.repeat(over, number)
                out.append(symbol[gone])
                owners.append(own[gone])
                symbol, own, rank = symbol[~gone], own[~gone], rank[~gone]
                least, number = least[~over], number[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, number))
            at = hit[np.concatenate(([True], own[hit[1:]] != own[hit[:-1]]))]
            symbol[at] = self.made[least]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, own, rank = symbol[keep], own[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = NONE
            for left in (at[at > 0] - 1, at[at < len(own) - 1]):
                left = left[own[left] == own[left + 1]]
                rank[left] = self.join(symbol[left], symbol[left + 1])
        ids, piece = np.concatenate(out), np.concatenate(owners)
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=m)

    def merge_long(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one long piece: all its places of the lowest rank are joined at once, as long as no pair that this makes has a lower rank still; else one by one."""
        n = len(piece)
        symbol = self.single[piece]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, NONE, dtype=np.int32)
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(places: np.ndarray) -> int:
            places = places[after[places] < n]
            found = self.join(symbol[places], symbol[after[places]])
            rank[places] = found
            places, found = places[found != NONE], found[found != NONE]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True]))) if len(found) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(found[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(places[a:b].astype(np.int32))
            return int(found[0]) if len(found) else int(NONE)

        offer(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of a run of places that overlap, every other one is joined, from the left.
            new = np.concatenate(([True], after[at[:-1]] != at[1:]))
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            gone = after[at]
            behind = after[gone]
            symbol[at], after[at], alive[gone] = self.made[r], behind, False
            rank[gone] = rank[at] = NONE
            inside = behind < n
            before[behind[inside]] = at[inside]
            left = before[at]
            left = left[left >= 0]
            rank[left] = NONE
            if offer(np.union1d(at, left)) < r and len(at) > 1:
                return np.array(merge(piece.tobytes(), self.ranks), dtype=np.int32)
        return symbol[alive]

def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of so many each, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, pair by pair with a heap: repeatedly join the adjacent pair of lowest rank, the leftmost of equals."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop or after[i] != j:  # one of the two has changed
            continue
        end[i], after[i], end[j] = stop, after[j], -1
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def piece_keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each piece: the very bytes and the size of up to eight bytes, two hashes of longer ones."""
    padded = np.concatenate((raw, np.zeros(8, dtype=np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    load = lambda at, left: np.ascontiguousarray(words[at]).view("<u8").ravel() & _LOW[np.minimum(left, 8)]
    with np.errstate(over="ignore"):
        a, b = load(start, size), size.astype(np.uint64)
        done = 8
        more = np.flatnonzero(size > done)
        while len(more):
            word = load(start[more] + done, size[more] - done)
            a[more], b[more] = tn.mix64(a[more] * _MULTIPLY[0] + word), tn.mix64((b[more] ^ word) * _MULTIPLY[1] + a[more])
            done += 8
            more = more[size[more] > done]
        return tn.mix64(a), b


class Pieces:
    """A cache from pre-tokens to ids: piece k has ids[bounds[k]:bounds[k + 1]]. It is kept within CACHE_BYTES; the first ``fixed`` pieces stay."""

    #: Bytes of a piece beside its ids: two halves of its key, its bound, its uses, and four slots of the table.
    EACH = 40

    def __init__(self) -> None:
        self._clear()
        self.fixed = 0

    def _clear(self) -> None:
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.ids, self.bounds, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int32), np.zeros(0, np.int32)
        self.slots = Slots(16)

    @property
    def n(self) -> int:
        return len(self.a)

    @property
    def size(self) -> int:
        return self.EACH * self.n + 4 * len(self.ids)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.slots.find(a, b, self.a, self.b)

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        n = self.n
        self.a, self.b = np.concatenate((self.a, a)), np.concatenate((self.b, b))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(count, dtype=np.int32)))
        self.uses = np.concatenate((self.uses, np.zeros(len(a), dtype=np.int32)))
        if 2 * self.n > len(self.slots.slot):
            self.slots = Slots(max(16, (4 * self.n - 1).bit_length()))
            self.slots.add(self.a, np.arange(self.n))
        else:
            self.slots.add(a, np.arange(n, self.n))

    def trim(self) -> None:
        """Beyond the bound, forgets the pieces used least until half of it is free."""
        if self.size <= CACHE_BYTES:
            return
        uses, count = self.uses.copy(), np.diff(self.bounds)
        uses[: self.fixed] = np.iinfo(np.int32).max
        order = np.argsort(-uses, kind="stable")
        room = np.cumsum(self.EACH + 4 * count[order].astype(np.int64)) <= CACHE_BYTES // 2
        room[: self.fixed] = True
        keep = np.sort(order[room])
        a, b, ids = self.a[keep], self.b[keep], self.ids[_spread(self.bounds[keep], count[keep])]
        held = self.uses[keep] // 2
        self._clear()
        self.add(a, b, ids, count[keep])
        self.uses = held


class Encoder:
    """Encodes runs of texts. ids_of gives the ids of distinct pieces of a buffer, end to end, with their numbers; long_ids those of one long piece; specials are strings that are tokens wherever a text has them."""

    def __init__(self, table: bytes, size: np.ndarray, ids_of: Callable, long_ids: Callable, specials: dict[bytes, int] | None = None) -> None:
        self.boundaries, self.pieces = Boundaries(table), Pieces()
        self.size, self.ids_of, self.long_ids = size, ids_of, long_ids
        self.specials = specials or {}
        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def _numbered(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b = piece_keys(raw, start, size)
        self.pieces.trim()
        number = self.pieces.find(a, b)
        if len(new := np.flatnonzero(number < 0)):
            key = np.stack((a[new], b[new]), axis=1)
            order = np.lexsort((key[:, 1], key[:, 0]))
            first = np.concatenate(([True], (key[order[1:]] != key[order[:-1]]).any(axis=1)))
            one = new[order[first]]
            ids, count = self.ids_of(raw, start[one], size[one])
            number[new[order]] = self.pieces.n + np.cumsum(first) - 1
            self.pieces.add(a[one], b[one], ids, count)
        self.pieces.uses += np.bincount(number, minlength=self.pieces.n).astype(np.int32)
        return number

    def _ids(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between the edges, end to end, and their numbers."""
        start, size = edges[:-1], np.diff(edges)
        known = self.pieces
        large = np.flatnonzero(size > LONG_BYTES)
        if not len(large):
            number = self._numbered(raw, start, size)
            count = np.diff(known.bounds)[number].astype(np.int64)
            return known.ids[_spread(known.bounds[number].astype(np.int64), count)], count
        count, parts, cuts = np.zeros(len(size), dtype=np.int64), [], [-1, *large.tolist(), len(size)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                ids, count[i + 1 : j] = self._ids(raw, edges[i + 1 : j + 1])
                parts.append(ids)
            if j < len(size):
                parts.append(self.long_ids(raw[edges[j] : edges[j + 1]]))
                count[j] = len(parts[-1])
        return np.concatenate(parts), count

    def _part(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges, first = self.boundaries.find(raw, offsets)
        ids, count = self._ids(raw, edges)
        cut = np.concatenate(([0], np.cumsum(count)))[first]
        where = np.cumsum(self.size[ids]) - self.size[ids]
        return ids, where - np.repeat(offsets[:-1], np.diff(cut)), cut

    def _long(self, raw: np.ndarray) -> np.ndarray:
        parts = [self._ids(raw[edges[0] : edges[-1]], edges - edges[0])[0] for edges in self.boundaries.windows(raw, tn.CHUNK_BYTES)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _cut(self, raw: np.ndarray) -> np.ndarray:
        """Ids of one text that is long or has special strings."""
        parts, at = [], 0
        for m in self.special.finditer(raw) if self.special else ():
            parts += [self._long(raw[at : m.start()]), np.array([self.specials[m[0]]], dtype=np.int32)]
            at = m.end()
        return np.concatenate([*parts, self._long(raw[at:])])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte at which each begins in its text, and the first id of each text."""
        if (self.special is None or not self.special.search(raw)) and (len(offsets) != 2 or len(raw) <= 2 * tn.CHUNK_BYTES):
            return self._part(raw, offsets)
        each = [self._cut(np.ascontiguousarray(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids, cut = np.concatenate(each), np.concatenate(([0], np.cumsum(list(map(len, each)))))
        where = np.concatenate(([0], np.cumsum(self.size[ids])))
        return ids, where[:-1] - np.repeat(where[cut[:-1]], np.diff(cut)), cut


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@lru_cache(2)
def _encoder(path: str, table: bytes) -> Encoder:
    own = _vocabulary(path)
    encoder = Encoder(table, own.size, own.merge, own.merge_long)
    # A pre-token that is a token has that id, whatever merges would give.
    has = np.flatnonzero((own.size > 0) & (own.size <= LONG_BYTES))
    encoder.pieces.add(*piece_keys(own.bytes, own.start[has], own.size[has]), has, np.ones(len(has), dtype=np.int64))
    encoder.pieces.fixed = len(has)
    return encoder


def _encoded(encoder: Encoder, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges of bounded bytes with their ids, offsets, and the first id of each row."""
    raw, off = tn.utf8(text)
    for i, j in tn.chunks(off):
        yield i, j, *encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])


def _decoded(ids: np.ndarray, offsets: np.ndarray, cut: np.ndarray, own: Vocabulary) -> pa.Array:
    """The bytes of each row of ids, each id's at its offset."""
    size = own.size[ids]
    base = np.concatenate(([0], np.cumsum(size)))
    if not np.array_equal(base[:-1] - np.repeat(base[cut[:-1]], np.diff(cut)), offsets):
        raise ValueError("ids and offsets do not belong together")
    whole = own.bytes[_spread(own.start[ids], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(base[cut].astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())


def _map(docs: DataFrame, run: Callable, key: str, columns: dict[str, str], made: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("key"), *(F.col(c).cast(t).alias(n) for n, (c, t) in columns.items()))
    return frame.mapInArrow(common.lean(run), f"key {kind}, {made}").withColumnRenamed("key", key)


_IDS = "ids array<int>, offsets array<int>"


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids array<int> and offsets array<int> (the byte of the text at which each id begins) of every row.

    One narrow pass; ranks_path must be readable on the executors.
    """
    table = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, table)
        for batch in batches:
            for i, j, ids, where, cut in _encoded(encoder, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), tn.ragged(ids, cut, pa.int32()), tn.ragged(where, cut, pa.int32())], names=["key", "ids", "offsets"])

    return _map(docs, run, key, {"text": (text, "string")}, _IDS)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """The columns of :func:`encode` with bytes binary, put together from the ids; an id at another place than its offset says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(ranks_path)
        for batch in batches:
            count = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tn.chunks(np.concatenate(([0], np.cumsum(count))), tn.CHUNK_BYTES // 4):
                part = batch.slice(i, j - i)
                flat, where = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "offsets"))
                made = _decoded(flat, where, np.concatenate(([0], np.cumsum(count[i:j]))), own)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*batch.schema.names, "bytes"])

    return _map(encoded, run, key, {"ids": ("ids", "array<int>"), "offsets": ("offsets", "array<int>")}, f"{_IDS}, bytes binary")


def encode_decode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", offsets: bool = True) -> DataFrame:
    """:func:`decode` of :func:`encode` in one pass: ids and offsets go on to the decoder within the task that made them, and without ``offsets`` end there."""
    table = class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own = _encoder(ranks_path, table), _vocabulary(ranks_path)
        for batch in batches:
            for i, j, ids, where, cut in _encoded(encoder, batch.column("text")):
                columns = {"key": batch.column("key").slice(i, j - i), "ids": tn.ragged(ids, cut, pa.int32())} | ({"offsets": tn.ragged(where, cut, pa.int32())} if offsets else {})
                yield pa.RecordBatch.from_pydict(columns | {"bytes": _decoded(ids, where, cut, own)})

    return _map(docs, run, key, {"text": (text, "string")}, f"{_IDS if offsets else 'ids array<int>'}, bytes binary")
