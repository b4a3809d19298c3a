"""Word shingles, hashed in vectors: lower-cased A-Z, words are runs of anything but ASCII white space."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (splitmix64's finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE, _NEAR, _FAR = constants(256, 1), constants(4096, 2), constants(4096, 3)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes."""
    edge = np.diff(np.concatenate(([False], _WORD[data], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, _U)
    size = ends - starts
    first = np.cumsum(size) - size
    inside = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    value = _BYTE[data[inside + np.repeat(starts, size)]] * _NEAR[inside & 4095]
    if size.max() > 4096:
        value *= _FAR[(inside >> 12) & 4095]
    return starts, mix(np.add.reduceat(value, first) + size.astype(_U))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; with fewer words, of all of them as one."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append(t.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size > 1 << 20:
            out += _sets(group, k)
            group, size = [], 0
    return out + (_sets(group, k) if group else [])


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    starts, word = _word_hashes(data)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    bound = np.searchsorted(starts, at).tolist()
    factor = constants(max(k, 1), 4)
    runs = sum((word[j : len(word) - k + 1 + j] * factor[j] for j in range(k)), np.zeros(max(0, len(word) - k + 1), _U)) if len(word) >= k else np.empty(0, _U)
    runs = mix(runs)
    sets = []
    for a, b in zip(bound, bound[1:], strict=False):
        if b - a >= k:
            sets.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            sets.append(mix(np.sum(word[a:b] * factor[: b - a], keepdims=True) + np.full(1, b - a, _U) * factor[:1]))
        else:
            sets.append(np.empty(0, _U))
    return sets
