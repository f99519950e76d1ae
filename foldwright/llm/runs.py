"""Vectorised hashing of byte runs (words) in a text buffer."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True


def spread_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes; lengths are 1 or more. Works in windows, so memory is bounded by the longest run."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    powers = _powers(int(lengths.max()))
    filled = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        before = filled[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(filled, before + _WINDOW, "right")))
        n = lengths[first:last]
        heads = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(heads, n)
        terms = (data[np.repeat(starts[first:last], n) + place].astype(np.uint64) + np.uint64(1)) * powers[place]
        out[first:last] = np.add.reduceat(terms, heads)
        first = last
    return mix(out ^ (lengths.astype(np.uint64) << np.uint64(48)))


def word_runs(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every run of `word` bytes in texts at `offsets`, and where each text's runs begin.

    By default runs are words of ASCII letters, digits and all characters beyond ASCII. There is one more entry in the
    third array than texts.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    head = np.zeros(len(data) + 1, dtype=bool)
    head[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | head[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | head[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1 - starts, np.searchsorted(starts, offsets)


def hash_prefixes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """A 64-bit hash of the first `size` bytes of every run, the whole run where it is shorter."""
    out, total = {}, np.zeros(len(starts), dtype=np.uint64)
    powers = _powers(max(sizes))
    for k in range(max(sizes)):
        there = lengths > k
        total[there] += (data[starts[there] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
        if k + 1 in sizes:
            out[k + 1] = mix(total ^ (np.minimum(lengths, k + 1).astype(np.uint64) << np.uint64(48)) ^ np.uint64(k + 1))
    return out
