"""Static range asymmetric numeral system over token ids: independent blocks of interleaved lanes.

All blocks share one table of frequencies that add up to 2**SCALE. A block holds whole documents. Its ids are dealt to
lanes in turn; a lane's state is a 64-bit number that gives or takes a 32-bit word when it leaves its range. Checkpoints
keep all lane states and the place in the words, so that a part of a block can be decoded alone. A checksum covers the
block's bytes and another its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCALE = 20
LANES = 2048
#: Ids after which a block is closed at the next document's end, and between two checkpoints.
BLOCK, CHECKPOINT = 1 << 19, 1 << 18
MAGIC = b"NLRANS1\n"
_HEAD = struct.Struct("<QIIIQII")  # ids, lanes, documents, checkpoints, ids before it in the file, words, checksum of the ids
_LOW = np.uint64(1 << 32)


class Table:
    """counts: how often each id occurs; only those over 0 get a share."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = np.asarray(counts, dtype=np.float64)
        self.freq = np.zeros(len(counts), dtype=np.int64)
        used = np.flatnonzero(counts)
        if len(used) > 1 << SCALE:
            raise ValueError(f"more than {1 << SCALE} different ids")
        if len(used):
            share = np.maximum(1, np.floor(counts[used] / counts[used].sum() * (1 << SCALE))).astype(np.int64)
            over = int(share.sum()) - (1 << SCALE)
            for i in np.argsort(-share, kind="stable"):
                if over == 0:
                    break
                take = over if over < 0 else min(over, int(share[i]) - 1)
                share[i] -= take
                over -= take
            self.freq[used] = share
        self.before = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(counts)), self.freq).astype(np.uint32)
        self.f, self.c = self.freq.astype(np.uint64), self.before.astype(np.uint64)


def encode_block(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int], before: int, table: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    rows = -(-n // lanes)
    every = max(1, CHECKPOINT // lanes)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    f, c = table.f[ids], table.c[ids]
    words, states = [], []
    for r in range(rows - 1, -1, -1):
        lo, hi = r * lanes, min(n, (r + 1) * lanes)
        y, fr = x[: hi - lo], f[lo:hi]
        full = (y >> np.uint64(64 - SCALE)) >= fr
        words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // fr
        x[: hi - lo] = (q << np.uint64(SCALE)) + (y - q * fr) + c[lo:hi]
        if r and r % every == 0:
            states.append((r, x.copy()))
    words.reverse()
    at = np.cumsum([0, *map(len, words)])
    body = [struct.pack("<II", r, int(at[r])) + s.astype("<u8").tobytes() for r, s in reversed(states)]
    known = np.array([d or 0 for d in doc_ids], dtype="<i8")
    ids = np.ascontiguousarray(ids, "<u4")
    head = _HEAD.pack(n, lanes, len(doc_ids), len(states), before, int(at[-1]), zlib.crc32(ids))
    data = b"".join([head, known.tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), np.array(sizes, dtype="<u4").tobytes(), *body, x.astype("<u8").tobytes(), *(w.tobytes() for w in words)])
    return struct.pack("<QI", len(data), zlib.crc32(data)) + data


class Block:
    def __init__(self, data: memoryview) -> None:
        self.n, self.lanes, docs, marks, self.before, n_words, self.ids_crc = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, unknown = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if u else d for d, u in zip(ids.tolist(), unknown.tolist(), strict=True)]
        self.sizes = take("<u4", docs).tolist()
        self.marks = [(*take("<u4", 2).tolist(), take("<u8", self.lanes)) for _ in range(marks)]
        self.marks.insert(0, (0, 0, take("<u8", self.lanes)))
        self.words = take("<u4", n_words)
        if at != len(data):
            raise ValueError("a block's length doesn't match its header")

    def decode_part(self, k: int, table: Table) -> np.ndarray:
        """The ids from checkpoint k to the next one."""
        row, at, states = self.marks[k]
        stop = self.marks[k + 1][0] if k + 1 < len(self.marks) else -(-self.n // self.lanes)
        x = states.astype(np.uint64)
        out = np.empty(min(self.n, stop * self.lanes) - row * self.lanes, dtype=np.uint32)
        mask, done = np.uint64((1 << SCALE) - 1), 0
        for r in range(row, stop):
            m = min(self.n - r * self.lanes, self.lanes)
            y = x[:m]
            slot = y & mask
            s = table.slot[slot]
            out[done : done + m] = s
            done += m
            y = table.f[s] * (y >> np.uint64(SCALE)) + slot - table.c[s]
            low = np.flatnonzero(y < _LOW)
            if len(low):
                y[low] = (y[low] << np.uint64(32)) | self.words[at : at + len(low)]
                at += len(low)
            x[:m] = y
        return out

    def decode(self, table: Table) -> np.ndarray:
        ids = np.concatenate([self.decode_part(k, table) for k in range(len(self.marks))])
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != self.ids_crc:
            raise ValueError("a block's ids don't match their checksum")
        return ids


def blocks(file: bytes | pa.Buffer) -> Iterator[Block]:
    file = memoryview(file)
    if file[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    while at < len(file):
        size, crc = struct.unpack_from("<QI", file, at)
        data = file[at + 12 : at + 12 + size]
        if len(data) != size or zlib.crc32(data) != crc:
            raise ValueError("a block is cut short or doesn't match its checksum")
        yield Block(data)
        at += 12 + size
