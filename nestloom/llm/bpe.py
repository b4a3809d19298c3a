"""Byte-level BPE by prefix dynamic programming (operator 2).

For each prefix of a pre-token the encoder keeps the one token that can end its encoding. A token t that is a suffix of
the prefix is that token exactly if it may follow the last token of the prefix before it, and two tokens may stand side
by side exactly if merging their joined bytes gives the two back. A stored prefix table is therefore extended by an
append without touching what is there, and an edit is recomputed only until the table agrees with the old one again.
Many short pre-tokens are taken at once, by arrays: their prefixes of one byte, then of two, and so on.

Nulls are encoded as empty texts; an empty text has no tokens. Equal rows give equal results; a row is returned for each
row. Only the id and text columns are read, so other columns can't clash. Texts are encoded whole, however long.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import give_back, holds, make_room, text_batches, text_or_empty
from .word_cache import LONGEST, WordCache

#: Pre-tokens, a quarter of the token pairs and words of a generation that a worker remembers; they only save time.
CACHE = 100_000
#: Bytes of the longest pre-token that is encoded beside others, and of those that are encoded at once.
SIDE_BY_SIDE, TOGETHER = 64, 1 << 17
#: Token pairs that those remember (a power of two); a pair that falls on another's place takes it.
PAIRS = 1 << 19


class Prefixes:
    """The last token of every prefix of some bytes."""

    __slots__ = ("data", "last")

    def __init__(self) -> None:
        self.data = bytearray()
        self.last = array("i")


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.many = _Many(self)

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """Merges neighbours of ranks under below: the lowest rank first, and of equal ones the leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None if t is a byte or no merge makes it."""
        if t not in self._halves:
            parts = self.merged(self.token[t], t)
            self._halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[t]

    def reachable(self, t: int) -> bool:
        return len(self.token[t]) == 1 or self.halves(t) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether the tokens stay side by side. Goes back in time over the tokens that met at this border: each pair of
        them must not have been merged before the later of the two was made."""
        a, b, until = left, right, 1 << 62
        if not (self.reachable(a) and self.reachable(b)):
            return False
        while True:
            if self.ranks.get(self.token[a] + self.token[b], 1 << 62) < until:
                return False
            x, y = (self.halves(t) if len(self.token[t]) > 1 else None for t in (a, b))
            if x is None and y is None:
                return True
            if y is None or x is not None and a > b:
                a, until = x[1], a  # of two merges of one rank the left one comes first
            else:
                b, until = y[0], b + 1

    def _extend(self, data: bytes | bytearray, last: array, begin: int, stop: int) -> Iterator[int]:
        """Appends to last, which covers data[:begin], the last tokens of the prefixes up to stop; yields their ends."""
        fits, size, at, known = self._fits, self.size, max(0, begin - self.longest), 0
        if len(fits) > CACHE * 4:
            fits.clear()
        for end, t in self.automaton.iter(data[at:stop].decode("latin-1")):
            n = size[t]
            end += at + 1
            if end <= begin or end == known or n > end:
                continue
            if n == end:
                good = self.reachable(t)
            else:
                left = last[end - n - 1]
                good = fits.get(left << 32 | t)
                if good is None:
                    good = fits[left << 32 | t] = self.fits(left, t)
            if good:
                if end != len(last) + 1:
                    break
                last.append(t)
                known = end
                yield end
        if len(last) != stop:
            raise ValueError("no token ends a prefix: the vocabulary lacks single bytes")

    def append(self, state: Prefixes, more: bytes) -> Prefixes:
        begin = len(state.data)
        state.data += more
        for _ in self._extend(state.data, state.last, begin, len(state.data)):
            pass
        return state

    def edit(self, state: Prefixes, start: int, stop: int, new: bytes) -> int:
        """Replaces bytes start:stop; returns how many prefixes were computed anew."""
        old_last, shift = state.last, len(new) - (stop - start)
        state.data[start:stop] = new
        state.last = old_last[:start]
        agree, done = 0, 0
        for end in self._extend(state.data, state.last, start, len(state.data)):
            done += 1
            was = end - 1 - shift
            agree = agree + 1 if end > start + len(new) and 0 <= was < len(old_last) and old_last[was] == state.last[-1] else 0
            if agree >= self.longest:
                state.last.extend(old_last[was + 1 :])
                break
        return done

    def tokens(self, state: Prefixes) -> list[int]:
        out, end = [], len(state.data)
        while end:
            t = state.last[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A whole pre-token. One that is itself a token is not merged, as in the library."""
        if (t := self.ranks.get(piece)) is not None:
            return [t]
        fits, size, last, done = self._fits, self.size, [], 0
        for end, t in self.automaton.iter(piece.decode("latin-1")):
            if end < done:
                continue
            n = size[t]
            if n > end:
                good = self.reachable(t)
            else:
                key = last[end - n] << 32 | t
                good = fits.get(key)
                if good is None:
                    good = fits[key] = self.fits(last[end - n], t)
            if good:
                last.append(t)
                done += 1
                if done != end + 1:
                    break
        if done != len(piece):
            raise ValueError("no token ends a prefix: the vocabulary lacks single bytes")
        if len(fits) > CACHE * 4:
            fits.clear()
        out, end = [], done
        while end:
            t = last[end - 1]
            out.append(t)
            end -= size[t]
        return out[::-1]


class _Many:
    """The same for many pre-tokens at once. An empty prefix's token is self.none, which any reachable token may follow."""

    def __init__(self, bpe: PrefixBPE) -> None:
        self.bpe = bpe
        self.none = max(bpe.token, default=-1) + 1
        self.size = np.zeros(self.none + 1, np.int64)
        for t, n in bpe.size.items():
            self.size[t] = n
        #: Halves of each token: -1 where there are none, -2 where they aren't known yet.
        self.halves = np.full((2, self.none + 1), -2, np.int64)
        self.halves[:, self.none] = -1
        pairs = {(x, y): t for b, t in bpe.ranks.items() for k in range(1, len(b)) if (x := bpe.ranks.get(b[:k])) is not None and (y := bpe.ranks.get(b[k:])) is not None}
        keys = np.array([self._key(x, y) for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.made = np.append(keys[order], 1 << 62), np.append(np.array(list(pairs.values()), np.int64)[order], 1 << 62)
        self.fits = np.full(PAIRS, -1, np.int64)

    def _key(self, left, right):
        return left * (self.none + 1) + right

    def _reachable(self, tokens: np.ndarray) -> np.ndarray:
        unknown = tokens[self.halves[0][tokens] == -2]
        for t in np.unique(unknown).tolist():
            self.halves[:, t] = self.bpe.halves(t) or -1 if len(self.bpe.token[t]) > 1 else -1
        return (self.halves[0][tokens] >= 0) | (self.size[tokens] == 1)

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """PrefixBPE.fits of many pairs."""
        good = self._reachable(right)
        good &= self._reachable(left) | (left == self.none)
        at = np.flatnonzero(good & (left != self.none))
        a, b, until = left[at], right[at], np.full(len(at), 1 << 62)
        while len(at):
            key = self._key(a, b)
            place = np.searchsorted(self.pairs, key)
            stays = np.where(self.pairs[place] == key, self.made[place], 1 << 62) >= until
            good[at[~stays]] = False
            self._reachable(a), self._reachable(b)
            x, y = self.halves[1][a], self.halves[0][b]
            more = stays & ((x >= 0) | (y >= 0))
            of_left = (y < 0) | (x >= 0) & (a > b)
            until = np.where(of_left, a, b + 1)[more]
            a, b, at = np.where(of_left, x, a)[more], np.where(of_left, b, y)[more], at[more]
        return good

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & (PAIRS - 1)
        held = self.fits[place]
        good = (held & 1).astype(bool)
        if len(lacking := np.flatnonzero(held >> 1 != key)):
            _, first, again = np.unique(key[lacking], return_index=True, return_inverse=True)
            some = lacking[first]
            fit = self._fit(left[some], right[some])
            good[lacking] = fit[again]
            self.fits[place[some]] = key[some] * 2 + fit
        return good

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces that are no tokens."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size + 1) - size  # after a mark that no token holds
        text = "\u0100" + "\u0100".join([p.decode("latin-1") for p in pieces]) + "\u0100"
        found = np.fromiter(itertools.chain.from_iterable(self.bpe.automaton.iter(text)), np.int64).reshape(-1, 2)
        own = np.repeat(start, size + 1)  # of each place, the start of the piece that stands or ends there
        length = (found[:, 0] - own[found[:, 0] - 1] + 1).astype(np.uint8)
        order = np.argsort(length, kind="stable")
        ends, tokens = found[order, 0], found[order, 1]
        befores = ends - self.size[tokens]
        last = np.full(len(text), -1, np.int64)
        last[np.append(start - 1, len(text) - 1)] = self.none
        stops = np.cumsum(np.bincount(length, minlength=1)).tolist()
        for lo, hi in itertools.pairwise(stops):  # prefixes of one length
            good = self._may_follow(last[befores[lo:hi]], tokens[lo:hi])
            last[ends[lo:hi][good]] = tokens[lo:hi][good]
        if (last < 0).any():
            raise ValueError("no token ends a prefix: the vocabulary lacks single bytes")
        at, kept = start + size - 1, np.zeros(len(text), bool)
        while len(at):
            kept[at] = True
            at = at - self.size[last[at]]
            at = at[last[at] != self.none]
        packed = last[kept].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(kept)[start + size - 1]).tolist()
        return [packed[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]


#: A space that doesn't stand alone between other characters, so a text can't simply be cut at its spaces.
_ODD = re.compile(r" (?:\s|\Z)|(?:\s|\A) ")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class _Pieces(dict):
    """Packed ids by pre-token."""

    def __init__(self, bpe: PrefixBPE) -> None:
        self.bpe = bpe

    def learn(self, pieces: Iterable[str]) -> None:
        ranks, waiting, size = self.bpe.ranks, {}, 0
        for piece in pieces:
            data = piece.encode()
            if (t := ranks.get(data)) is not None:
                self[piece] = t.to_bytes(4, "little")
            elif len(data) > SIDE_BY_SIDE:
                self[piece] = b"".join(t.to_bytes(4, "little") for t in self.bpe.encode(data))
            else:
                waiting[piece] = data
                size += len(data)
                if size >= TOGETHER:
                    self.update(zip(waiting, self.bpe.many.encode(list(waiting.values())), strict=True))
                    waiting, size = {}, 0
        if waiting:
            self.update(zip(waiting, self.bpe.many.encode(list(waiting.values())), strict=True))

    def joined(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list's pieces. Long pieces aren't kept."""
        if len(self) >= CACHE:
            self.clear()
        lacking = set(itertools.chain.from_iterable(split)).difference(self)
        self.learn(lacking)
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in split]
        for piece in lacking:
            if len(piece) > LONGEST:
                del self[piece]
        return out


class TextCodec:
    """Whole texts. A text is cut before single spaces between other characters, where every match of the pattern ends."""

    def __init__(self, file: str) -> None:
        self.bpe = PrefixBPE(vocab.byte_ranks(file))
        self.pattern = regex.compile(vocab.PATTERN)
        self.pieces = _Pieces(self.bpe)
        self.first = WordCache(lambda words: self.pieces.joined([self.pattern.findall(w) for w in words]), CACHE)
        self.after = WordCache(lambda words: self.pieces.joined([self.pattern.findall(" " + w) for w in words]), CACHE)
        tokens = [self.bpe.token.get(i, b"") for i in range(max(self.bpe.token, default=0) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(b) for b in tokens])
        self.start = np.cumsum(self.size) - self.size

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        heads, rests = [], []
        for text in texts:
            if _ODD.search(text):
                parts = _CUT.split(text)
                rests.append([s[1:] for s in parts[1:]])
                heads.append(parts[0])
            else:
                head, *rest = text.split(" ")
                heads.append(head)
                rests.append(rest)
        first, after = self.first.holding(set(heads)), self.after.holding(set().union(*rests))
        return [first[h] + b"".join(map(after.__getitem__, r)) for h, r in zip(heads, rests, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        t = np.frombuffer(ids, dtype="<u4")
        size = self.size[t]
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[t] - ends + size, size)].tobytes()


@functools.lru_cache(maxsize=2)
def codec(file: str) -> TextCodec:
    return TextCodec(file)


holds(__name__, codec.cache_clear)


def encode_decode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """For each row: the id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids, packed as 32-bit integers."""
    text_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = ", ids binary" if keep_ids else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        c = codec(file)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                n, a, b, kept = [], [], [], []
                for ids in c.encode_many(part.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)
        give_back()

    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text_")).mapInArrow(run, f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
