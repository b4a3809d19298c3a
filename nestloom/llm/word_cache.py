"""What a worker has computed of different texts. A batch's words are numbered by their dictionary; what is known of them is
found and gathered by arrays, so that no work is done for each word of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of remembered texts; long ones are no reason to keep more.
MOST_BYTES = 64 << 20


#: Values that are gathered at once, as their places take several times their room.
CHUNK = 1 << 17


def gathered(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values, one after the other, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, values.dtype)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(CHUNK, total, CHUNK)) + 1, len(ends))).tolist()
    begin = done = 0
    for stop in cuts:
        n, to = size[begin:stop], int(ends[stop - 1]) if stop else 0
        places = np.repeat(first[begin:stop] - ends[begin:stop] + n + done, n)
        places += np.arange(to - done)
        out[done:to] = values[places]
        begin, done = stop, to
    return out, ends


def joined(texts: pa.Array, mark: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), mark)[0].as_py()


class Known:
    """Ids of texts by number of the text, all in one array."""

    def __init__(self, unit: str) -> None:
        self.texts = pa.array([], pa.string())
        self.ids, self.used = np.empty(1 << 16, unit), 0
        self.start = np.zeros(1 << 16, np.int64)  # of each text, and the end of the last

    def add(self, texts: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        n, new = len(self.texts), len(texts)
        if len(size) != new:
            raise ValueError("not every text has ids")
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(ids), self.used), self.ids.dtype)])
        if n + new + 1 > len(self.start):
            self.start = np.concatenate([self.start[: n + 1], np.empty(max(new, n) + 1, np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : n + 1 + new] = self.used + np.cumsum(size)
        self.texts = pa.concat_arrays([self.texts, texts])
        self.used += len(ids)

    def full(self, more: int, most: int) -> bool:
        return len(self.texts) + more > most or self.texts.nbytes > MOST_BYTES

    def find(self, texts: pa.Array) -> np.ndarray:
        """The texts' numbers; -1 where one isn't known."""
        return found(self.texts, texts)

    def gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.start[number]
        return gathered(self.ids, first, self.start[number + 1] - first)


def found(known: pa.Array, texts: pa.Array) -> np.ndarray:
    """Where the texts stand among those known, or -1."""
    return pc.fill_null(pc.index_in(texts, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


#: Words of a generation, and characters of the longest word that is kept.
GENERATION, LONGEST = 400_000, 64


class WordCache:
    def __init__(self, make_many: Callable[[list[str]], Iterable], generation: int = GENERATION) -> None:
        self.make_many, self.generation = make_many, generation
        self.young: dict = {}
        self.old: dict = {}

    def holding(self, words: set[str]) -> dict:
        """A mapping that has all these words, valid until the next call."""
        if len(self.young) >= self.generation:
            self.old = {w: v for w, v in self.young.items() if len(w) <= LONGEST}
            self.young = {}
        young, old = self.young, self.old
        if lacking := [w for w in words if w not in young]:
            made = []
            for w in lacking:
                if w in old:
                    young[w] = old[w]
                else:
                    made.append(w)
            young.update(zip(made, self.make_many(made), strict=True))
        return young
