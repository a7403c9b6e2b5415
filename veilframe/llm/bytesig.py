"""Word hashes of UTF-8 text, computed with numpy on whole byte buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.cumprod(out, dtype=U)


_UP: list[np.ndarray] = []
_SYMBOL = np.arange(1, 257, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SYMBOL = mix(_SYMBOL * U(0xD1342543DE82EF95))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP or len(_UP[0]) < n:
        size = max(n, _BLOCK + 1)
        _UP[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _UP[0], _UP[1]


# fixed values: ASCII letters and digits and every byte of a non-ASCII character belong to words
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
# fixed values: the six ASCII white-space bytes
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes for which inside[byte]; rows bound runs."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    here = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = here.copy()
    start[1:] &= ~here[:-1] | first[1:-1]
    end = here.copy()
    end[:-1] &= ~here[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, in blocks of runs so that memory doesn't follow the text's length."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        up, down = _tables(int(ends[to - 1] - base) + 1)
        part = _SYMBOL[data[base : ends[to - 1]]]
        part *= up[: len(part)]
        total = np.concatenate([np.zeros(1, U), np.cumsum(part, dtype=U)])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(U)
        at = to
    return mix(out)


def windows(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words (by position; callers drop those that cross rows)."""
    if len(words) < n:
        return np.empty(0, U)
    out = np.full(len(words) - n + 1, U(seed + 1))
    for j in range(n):
        out = mix(out ^ words[j : len(words) - n + 1 + j]) + U(j + 1)
    return mix(out)
