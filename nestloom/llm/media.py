"""Media columns by signature sniffing (operator 3).

One pass of an Aho-Corasick automaton finds the magic bytes of all formats; a validator for each format then walks the
structure from there (chunks, blocks, boxes, checksums) and gives the length, or refuses. What starts at the first byte
and is confirmed corrects the declared type; what is confirmed inside is carved out: the first of overlapping ones wins,
and nothing inside a carved piece is carved again. Magic bytes alone, as they occur in any text, change nothing. What
validators look for far ahead is located once for a value, so many magic bytes in a long value stay cheap.

Texts are stored as sounds in a table of media, which is written and read again before features are computed.

A null or empty value has type null and nothing inside. Rows are independent, so ties, repeated rows and empty tables need
nothing special. Only the id, value and declared columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_or_empty, written

#: Bytes to a multiple of which a stored text is filled up, and the filling.
UNIT, FILL = 576, b"\xff"
RATE = 8000


class Places:
    """Where patterns stand in a value, each searched once."""

    def __init__(self, value: bytes) -> None:
        self.value = value
        self._found: dict[bytes, list[int]] = {}
        self._archives: dict[int, int] | None = None

    def all(self, pattern: bytes) -> list[int]:
        if pattern not in self._found:
            self._found[pattern] = [m.start() for m in re.finditer(pattern, self.value, re.S)]
        return self._found[pattern]

    def next(self, pattern: bytes, at: int) -> int:
        """The first place from `at` on, or -1."""
        found = self.all(pattern)
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def archives(self) -> dict[int, int]:
        """Ends of zip archives by their starts, which the end records tell; of several ends the first."""
        if self._archives is None:
            self._archives = {}
            for end in self.all(rb"PK\x05\x06"):
                if end + 22 <= len(self.value):
                    entries, size, offset, note = struct.unpack_from("<HIIH", self.value, end + 10)
                    start = end - offset - size
                    if start >= 0 and entries and self.value[start + offset : start + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(self.value):
                        self._archives.setdefault(start, end + 22 + note)
        return self._archives


def _png(b: memoryview, at: int, places: Places) -> int | None:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if first and kind != b"IHDR" or pos + 12 + size > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        first, pos = False, pos + 12 + size
        if kind == b"IEND":
            return pos - at
    return None


def _gif(b: memoryview, at: int, places: Places) -> int | None:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def sub_blocks(pos: int) -> int | None:
        while pos < len(b):
            if not b[pos]:
                return pos + 1
            pos += 1 + b[pos]
        return None

    if at + 13 > len(b):
        return None
    pos: int | None = at + 13 + table(b[at + 10])
    images = 0
    while pos is not None and pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if images else None
        if b[pos] == 0x21:
            pos = sub_blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            images += 1
            pos = sub_blocks(pos + 10 + table(b[pos + 9]) + 1)
        else:
            return None
    return None


def _jpeg(b: memoryview, at: int, places: Places) -> int | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or kind < 0xC0:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if kind == 0xDA:  # coded data goes on to the next marker that is neither stuffed nor a restart
            if (pos := places.next(rb"\xff(?=[^\x00\xd0-\xd7])", pos)) < 0:
                return None
            if b[pos + 1] == 0xD9:
                return pos + 2 - at if frame else None
    return None


def _riff(b: memoryview, at: int, places: Places) -> int | None:
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if kind not in (b"WAVE", b"WEBP") or end > len(b):
        return None
    pos, names = at + 12, []
    while pos + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, pos)
        names.append(bytes(name))
        pos += 8 + n + n % 2
    ok = {b"fmt ", b"data"} <= set(names) if kind == b"WAVE" else bool({b"VP8 ", b"VP8L", b"VP8X"} & set(names))
    return end - at if ok and pos in (end, end + 1) else None


def _bmp(b: memoryview, at: int, places: Places) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, offset, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or head not in (40, 52, 56, 108, 124) or width <= 0 or not height:
        return None
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    return size if offset >= 14 + head and offset + rows <= size <= len(b) - at else None


def _pdf(b: memoryview, at: int, places: Places) -> int | None:
    if not re.match(rb"[0-9]\.", b[at + 5 : at + 7]):
        return None
    start = places.next(b"startxref", at)
    end = places.next(b"%%EOF", start)
    if start < 0 or end < 0 or not 0 <= places.next(b"endobj", at) < start:
        return None
    return end + 5 - at


def _zip(b: memoryview, at: int, places: Places) -> int | None:
    return places.archives().get(at, at) - at or None


def _ogg(b: memoryview, at: int, places: Places) -> int | None:
    pos, pages = at, 0
    while pos + 27 <= len(b) and b[pos : pos + 4] == b"OggS":
        n = b[pos + 26]
        if b[pos + 4] or pos + 27 + n > len(b):
            return None
        last = b[pos + 5] & 4
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        pages += 1
        if pos > len(b):
            return None
        if last:
            return pos - at
    return pos - at if pages > 1 else None


def _gzip(b: memoryview, at: int, places: Places) -> int | None:
    z = zlib.decompressobj(31)
    try:
        pos = at
        while not z.eof and pos < len(b):
            z.decompress(b[pos : pos + (1 << 16)], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            pos += min(1 << 16, len(b) - pos)
    except zlib.error:
        return None
    return pos - len(z.unused_data) - at if z.eof else None


#: Magic bytes, the type they stand for, and what confirms it.
FORMATS: list[tuple[bytes, str, Callable[[memoryview, int, Places], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"OggS", "application/ogg", _ogg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]


@functools.lru_cache(maxsize=1)
def _magic() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Found:
    offset: int
    length: int
    type: str


def sniff(value: bytes) -> tuple[Found | None, list[Found]]:
    """What the value is, and what is embedded in it."""
    view, places, whole, inside, free = memoryview(value), Places(value), None, [], 0
    for end, i in _magic().iter(value.decode("latin-1")):
        magic, kind, confirm = FORMATS[i]
        at = end + 1 - len(magic)
        if at < free or not (size := confirm(view, at, places)):
            continue
        if kind == "riff":
            kind = "audio/wav" if value[at + 8 : at + 12] == b"WAVE" else "image/webp"
        found = Found(at, size, kind)
        if at == 0:
            whole = found
            if size < len(value):
                free = size
        else:
            inside.append(found)
            free = at + size
    return whole, inside


_SNIFFED = "declared string, detected string, corrected boolean, length bigint, embedded array<struct<offset:bigint,length:bigint,type:string,content:binary>>"


def sniff_media(rows: DataFrame, id_col: str, value_col: str, declared_col: str) -> DataFrame:
    """For each row: the id, declared, detected, corrected (detected, and not as declared), length, embedded."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, declared in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_py() or b""
                whole, inside = sniff(data)
                parts = [{"offset": f.offset, "length": f.length, "type": f.type, "content": data[f.offset : f.offset + f.length]} for f in inside]
                out.append((declared, whole and whole.type, whole is not None and whole.type != declared, whole.length if whole else None, parts))
            part = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())])
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(part)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "declared", "detected", "corrected", "length", "embedded"])

    return rows.select(id_col, value_col, declared_col).mapInArrow(run, f"{id_col} {id_type}, {_SNIFFED}")


def wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono samples. Their number is even, so no filling follows them."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    pos = 12
    while pos + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, pos)
        if name == b"data":
            return media[pos + 8 : pos + 8 + n]
        pos += 8 + n + n % 2
    raise ValueError("no samples")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media, declared, as a written table: each text's bytes, filled up, as the samples of a sound; the declared
    type tells nothing."""
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = [t.encode() for t in part.column(1).to_pylist()]
                media = [wav(t + FILL * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    media = docs.select(F.col(id_col), text_or_empty(text_col).alias("text_")).mapInArrow(run, f"{id_col} {id_type}, n_bytes bigint, media binary")
    return written(media.withColumn("declared", F.lit("application/octet-stream")), "media", "zstd")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each stored sound, as read back: payload and media digests, and what sniffing and its samples show."""
    id_type = stored.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, declared in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                media = value.as_py()
                whole, inside = sniff(media)
                if whole is None or whole.type != "audio/wav" or whole.length != len(media):
                    raise ValueError("a stored sound isn't one")
                payload = samples_of(media)
                x = np.frombuffer(payload, np.uint8)
                crossings = int(np.count_nonzero(np.diff(x >= 128)))
                feature = f"{declared}>{whole.type};embedded={len(inside)};sum={int(x.sum(dtype=np.int64))};crossings={crossings};peak={int(x.max())}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=names)

    return stored.select(id_col, "n_bytes", "media", "declared").mapInArrow(run, f"{id_col} {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
