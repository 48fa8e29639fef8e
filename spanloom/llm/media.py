"""Baseline JPEG: a payload kept losslessly as coefficients, decoded in numpy.

The discrete cosine transform of 8-bit samples rounds, so the payload is stored in the format's own
lossless unit, the quantised coefficient: 64 payload bytes are the 64 coefficients of one block in
zigzag order, byte b as b - 128 below 128 and b - 127 from there on (never 0). The Huffman table
gives a coefficient of s bits a code of 9 - s bits, so each takes 9 bits and a block 72 bytes; a
restart marker after each block lets a reader decode all blocks side by side. Images are about
square; blocks beyond the payload are empty. A comment segment holds the unpadded length.

:func:`decode_scan` is a decoder of baseline scans in general: any Huffman tables, restart intervals,
run lengths and chroma sampling; restart segments are its lanes.

Cases: a null text is as an empty one, a block of zeros; repeated rows and equal texts give equal
files and features; a very long text is one image, up to the format's 65,535 samples a side (some
67 million blocks, 4 GB), beyond which it is an error; an empty table gives no rows; a file that is
no baseline JPEG, or ends early, is an error; columns other than the key and the text (or media) are
left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

BLOCK = 64
#: Code lengths 1 to 9 of sizes 8 to 1 and, last, of "nothing more"; a fixed value of this store.
_SYMBOLS = [8, 7, 6, 5, 4, 3, 2, 1, 0]
_COUNTS = [1, 1, 1, 1, 1, 1, 1, 1, 1] + [0] * 7
EMPTY_BITS = 0b111111110


def _codes() -> np.ndarray:
    """The 9 bits of each byte: the code of its size, then its amplitude."""
    out = np.zeros(256, dtype=np.uint16)
    for b in range(256):
        value = b - 128 if b < 128 else b - 127
        size = abs(value).bit_length()
        code = (1 << (9 - size)) - 2  # the first code of its length, as all shorter ones are ones and a 0
        out[b] = code << size | (value if value > 0 else value + (1 << size) - 1)
    return out


_CODE = _codes()
_BYTE = np.zeros(257, dtype=np.uint8)  # by coefficient + 128
_BYTE[:128], _BYTE[129:] = np.arange(128), np.arange(128, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down."""
    wide = max(1, int(np.ceil(np.sqrt(blocks))))
    return wide, -(-blocks // wide)


def _header(blocks: int, n_bytes: int) -> bytes:
    wide, high = shape(blocks)
    if 8 * max(wide, high) > 0xFFFF:
        raise ValueError("the payload exceeds the sides of a JPEG image")
    table = bytes(_COUNTS) + bytes(_SYMBOLS)
    return (
        b"\xff\xd8"
        + _segment(0xFE, b"payload %d" % n_bytes)
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + table)
        + _segment(0xC4, b"\x10" + table)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0x00, 0, 63, 0))
    )


def encode_payloads(payload: np.ndarray, blocks: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
    """JPEG files of payloads laid end to end, of so many blocks each."""
    bits = _CODE[payload].reshape(-1, 8, 8).astype(np.uint64)  # eight codes of 9 bits are 72 bits: 64 and 8
    high = np.zeros(bits.shape[:2], dtype=np.uint64)
    for k in range(7):
        high = high << np.uint64(9) | bits[:, :, k]
    high = high << np.uint64(1) | bits[:, :, 7] >> np.uint64(8)
    packed = np.empty((*bits.shape[:2], 9), dtype=np.uint8)
    packed[:, :, :8] = high.astype(">u8").view(np.uint8).reshape(*bits.shape[:2], 8)
    packed[:, :, 8] = bits[:, :, 7] & np.uint64(0xFF)
    packed = packed.reshape(-1, 72)
    # An empty block: difference 0 and "nothing more", each EMPTY_BITS, filled up with ones.
    empty = ((EMPTY_BITS << 9 | EMPTY_BITS) << 6 | 0b111111).to_bytes(3, "big").replace(b"\xff", b"\xff\x00")
    stuffed = packed == 0xFF
    grow = 1 + stuffed.astype(np.int64)
    at = np.cumsum(grow.ravel() + np.tile(np.array([0] * 71 + [2]), len(packed))) - 1 - np.tile(np.array([0] * 71 + [2]), len(packed)) - stuffed.ravel()
    total = int(grow.sum()) + 2 * len(packed)
    flat = np.zeros(total, dtype=np.uint8)
    flat[at] = packed.ravel()
    ends = np.cumsum(grow.sum(axis=1) + 2)
    flat[ends - 2] = 0xFF
    first = np.cumsum(blocks) - blocks
    flat[ends - 1] = 0xD0 + (np.arange(len(packed)) - np.repeat(first, blocks)) % 8
    edges = np.concatenate(([0], ends))
    out = []
    for k, (a, n, size) in enumerate(zip(first.tolist(), blocks.tolist(), n_bytes.tolist(), strict=True)):
        wide, tall = shape(n)
        rest = b"".join(empty + bytes([0xFF, 0xD0 + (n + i) % 8]) for i in range(wide * tall - n))
        scan = flat[edges[a] : edges[a + n]].tobytes() + rest
        out.append(_header(n, size) + scan[:-2] + b"\xff\xd9")  # no marker follows the last block
    return out


@dataclass
class Component:
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Jpeg:
    """The parsed markers of a baseline file."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    interval: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: dict[int, Component] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    scan: tuple[int, int] = (0, 0)

    @property
    def units(self) -> list[Component]:
        """The components of the blocks of one unit of the scan, in order."""
        if len(self.order) == 1:
            return [self.parts[self.order[0]]]
        return [self.parts[i] for i in self.order for _ in range(self.parts[i].across * self.parts[i].down)]

    @property
    def grid(self) -> tuple[int, int]:
        """Units across and down."""
        if len(self.order) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        a, d = max(p.across for p in self.parts.values()), max(p.down for p in self.parts.values())
        return -(-self.width // (8 * a)), -(-self.height // (8 * d))


def parse(data: bytes) -> Jpeg:
    """Reads the markers up to the one scan of a baseline file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = Jpeg(), 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDD:
            (out.interval,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                out.quant[body[k] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=k + 1)
                k += 1 + 64 * (2 if wide else 1)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                out.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xC0:
            _, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                name, sampling, quant = body[6 + 3 * k : 9 + 3 * k]
                out.parts[name] = Component(sampling >> 4, sampling & 15, quant)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline file")
        elif marker == 0xDA:
            for k in range(body[0]):
                name, table = body[1 + 2 * k : 3 + 2 * k]
                out.parts[name].dc, out.parts[name].ac = table >> 4, table & 15
                out.order.append(name)
            end = data.rfind(b"\xff\xd9")
            out.scan = at, end if end >= at else len(data)
            return out


def huffman(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length of its code; 0 where there is none."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = table[k] << 8 | length
            code += 1
            k += 1
        code <<= 1
    return out


def segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing or restart markers, and the first byte of each restart segment and the end."""
    full = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
    follow = scan[full + 1] if len(full) else full
    keep = np.ones(len(scan), dtype=bool)
    keep[full[follow == 0] + 1] = False
    marks = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    before = np.concatenate(([0], np.cumsum(keep)))
    return scan[keep], np.concatenate(([0], before[marks], [before[-1]]))


def decode_scan(data: np.ndarray, start: np.ndarray, units: np.ndarray, layout: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients (lane, unit, block, 64) of lanes that begin at bytes start and have so many units each.

    layout has for each block of a unit its component and its tables of differences and coefficients.
    Every step decodes one symbol of each unfinished lane.
    """
    data = np.concatenate((data, np.full(8, 0xFF, dtype=np.uint8)))
    lanes, most = len(start), int(units.max(initial=0))
    words = np.zeros(len(data) - 4, dtype=np.uint32)
    for k in range(4):
        words = words << np.uint32(8) | data[k : len(data) - 4 + k]
    out = np.zeros((lanes, most, len(layout), 64), dtype=np.int16)
    bit = start.astype(np.int64) * 8
    last = np.zeros((lanes, 1 + max(p for p, _, _ in layout)), dtype=np.int32)

    def take(live: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and amplitudes at the lanes' positions, which move on."""
        at = bit[live]
        word = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(np.uint32)
        found = table[word >> np.uint32(16)]
        length = found & np.uint32(255)
        if not length.all():
            raise ValueError("a code that the table lacks")
        symbol = found >> np.uint32(8)
        size = symbol & np.uint32(15)
        at = at + length
        word = words[np.minimum(at >> 3, len(words) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)
        bits = ((word & np.uint64(0xFFFFFFFF)) >> np.uint64(16)).astype(np.int32) >> (16 - size.astype(np.int32))
        low = (np.int32(1) << size.astype(np.int32)) >> 1
        value = np.where(bits < low, bits - 2 * low + 1, bits)
        value[size == 0] = 0
        bit[live] = at + size
        return symbol, value

    for unit in range(most):
        here = np.flatnonzero(units > unit)
        for block, (part, dc, ac) in enumerate(layout):
            _, value = take(here, dc)
            last[here, part] += value
            out[here, unit, block, 0] = last[here, part]
            at = np.zeros(lanes, dtype=np.int64)
            live = here
            while len(live):
                symbol, value = take(live, ac)
                run = (symbol >> np.uint32(4)).astype(np.int64)
                size = symbol & np.uint32(15)
                at[live] += run + 1
                put = size > 0
                if not put.all():
                    done = ~put & (run != 15)
                    out[live[put], unit, block, at[live[put]]] = value[put]
                    live = live[~done]
                else:
                    out[live, unit, block, at[live]] = value
                live = live[at[live] < 63]
    return out


def read(files: list[bytes]) -> tuple[list[Jpeg], list[np.ndarray]]:
    """Parsed files and their coefficients, (units, blocks of a unit, 64) each; files with the same tables are decoded side by side."""
    heads = [parse(f) for f in files]
    out: list[np.ndarray] = [np.zeros(0)] * len(files)
    groups: dict[tuple, list[int]] = {}
    for k, h in enumerate(heads):
        groups.setdefault((tuple((h.order.index(i) if (i := n) in h.order else 0, h.parts[n].dc, h.parts[n].ac, h.parts[n].across, h.parts[n].down) for n in h.order), tuple(sorted(h.tables.items())), h.interval), []).append(k)
    for members in groups.values():
        head = heads[members[0]]
        tables = {k: huffman(t) for k, t in head.tables.items()}
        names = [n for n in head.order for _ in range(1 if len(head.order) == 1 else head.parts[n].across * head.parts[n].down)]
        layout = [(head.order.index(n), tables[head.parts[n].dc], tables[16 + head.parts[n].ac]) for n in names]
        datas, starts, counts, owners, base = [], [], [], [], 0
        for k in members:
            a, b = heads[k].scan
            data, edges = segments(np.frombuffer(files[k], dtype=np.uint8)[a:b])
            total = heads[k].grid[0] * heads[k].grid[1]
            step = heads[k].interval or total
            n = -(-total // step)
            if n != len(edges) - 1:
                raise ValueError("restart markers do not fit the interval")
            datas.append(data)
            starts.append(edges[:-1] + base)
            counts.append(np.minimum(step, total - step * np.arange(n)))
            owners.append(n)
            base += len(data)
        units = np.concatenate(counts)
        got = decode_scan(np.concatenate(datas), np.concatenate(starts), units, layout)
        lane = 0
        for k, n in zip(members, owners, strict=True):
            own = got[lane : lane + n]
            out[k] = own.reshape(-1, *own.shape[2:])[(np.arange(own.shape[1]) < units[lane : lane + n, None]).ravel()]
            lane += n
    return heads, out


def thumbnail(head: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of each block from its first coefficient alone."""
    wide, high = head.grid
    part = head.parts[head.order[0]]
    across, down = (1, 1) if len(head.order) == 1 else (part.across, part.down)
    first = coefficients[:, : across * down, 0].astype(np.int32) * int(head.quant[part.quant][0])
    plane = first.reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
    return np.clip(plane // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: on a grid of 8 rows of 9 sampled points, whether each is brighter than its right neighbour."""
    rows = (np.arange(8) * image.shape[0]) // 8
    columns = (np.arange(9) * image.shape[1]) // 9
    grid = image[np.ix_(rows, columns)].astype(np.int16)
    return int.from_bytes(np.packbits(grid[:, :-1] > grid[:, 1:]).tobytes(), "big")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the JPEG file of the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64. A null text is as an empty one: one block of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tn.utf8(batch.column(1))
            for i, j in tn.chunks(off, tn.CHUNK_BYTES // 2):
                n = np.diff(off[i : j + 1])
                blocks = np.maximum(1, -(-n // BLOCK))
                first = (np.cumsum(blocks) - blocks) * BLOCK
                payload = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint8)
                payload[np.repeat(first - (off[i:j] - off[i]), n) + np.arange(off[j] - off[i])] = raw[off[i] : off[j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(encode_payloads(payload, blocks, n), type=pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash long, feature string"


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dimensions, thumbnail hashes and checks of stored files, all computed from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)))).astype(np.int64)
            for i, j in tn.chunks(size, tn.CHUNK_BYTES // 2):
                files = column.slice(i, j - i).to_pylist()
                heads, coefficients = read(files)
                rows = []
                for data, head, values in zip(files, heads, coefficients, strict=True):
                    n_bytes = int(head.comment.split()[1])
                    blocks = max(1, -(-n_bytes // BLOCK))
                    payload = _BYTE[values[:blocks, 0].astype(np.int32) + 128].tobytes()
                    mark = difference_hash(thumbnail(head, values))
                    signed = mark - (1 << 64) if mark >> 63 else mark
                    rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), head.width, head.height, signed, f"{head.width}x{head.height}:{mark:016x}"))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["key", *(x.split()[0] for x in READ.split(", "))])

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), "media").mapInArrow(run, f"key {kind}, {READ}").withColumnRenamed("key", key)
