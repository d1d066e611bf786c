"""Word-shingle hashing for whole Arrow batches, as a numpy helper of Spark tasks.

Words are maximal runs of bytes other than white space (space, tab to carriage return),
A-Z lower-cased.  A document's tokens are the 64-bit hashes of its distinct word n-grams;
a document of fewer words has its whole sequence as its only token.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at once; a longer document is hashed alone.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = [np.uint64((k * 2 + 1) * 0xD6E8FEB86659FD93 & _MASK) for k in range(1, 65)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that begin at `starts` in `data`; the first word of each text."""
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True  # an empty text at the end starts at n
    edge[n] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:n]
    last = ~space
    last[:-1] &= space[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[:n], out=total[1:])
    raw = (total[end + 1] - total[begin]) * down[begin]
    return mix(raw + (end - begin).astype(np.uint64) * _STEP[0]), np.searchsorted(begin, starts)


def token_sets(texts: list[bytes | None], size: int):
    """For each text in order, the sorted distinct hashes of its word n-grams of `size`."""
    at, many = 0, len(texts)
    while at < many:
        stop, total = at, 0
        while stop < many and (stop == at or total + len(texts[stop] or b"") <= BLOCK):
            total += len(texts[stop] or b"")
            stop += 1
        block = [x or b"" for x in texts[at:stop]]
        data = np.frombuffer(b"".join(block), np.uint8)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        starts = np.cumsum(lengths) - lengths
        if len(data):
            words, first = word_hashes(data, starts)
        else:
            words, first = np.empty(0, np.uint64), np.zeros(len(block), np.int64)
        bounds = np.append(first, len(words))
        grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            grams += words[k : k + len(grams)] * _STEP[k]
        grams = mix(grams)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for k in range(b - a):
                    short = mix(short + words[a + k : a + k + 1] * _STEP[k + 32])
                yield short
            else:
                yield np.empty(0, np.uint64)
        at = stop
