"""Hashed word shingles of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: A-Z lowered, white space (blank and bytes 9 to 13) to blanks, all else kept.
SPACES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

#: Bytes whose words are hashed at once.
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of the base and of its inverse."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return values, *(_powers(b) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * BLOCK, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in bytes that begin and end with a blank."""
    starts, hashes, at = [], [], 0
    while at < len(data) - 1:
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and data[stop - 1] != 32:
            stop = min(len(data), stop + (1 << 12))
            tail = np.flatnonzero(data[at + BLOCK : stop] == 32)
            if len(tail):
                stop = at + BLOCK + int(tail[0]) + 1
        own = data[at:stop]
        inside = own != 32
        begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        values, powers, inverse = _tables()
        if len(own) > len(powers):
            powers, inverse = (np.cumprod(np.concatenate([p[:1], np.full(len(own), p[1], dtype=np.uint64)])) for p in (powers, inverse))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[own] * powers[: len(own)], dtype=np.uint64)])
        starts.append(begin + at)
        hashes.append(mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
        at = stop - 1
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words is one shingle of all of them, one without words has none.
    """
    parts = [t.translate(SPACES) for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    starts, words = word_hashes(data)
    first_bytes = np.cumsum([0, *(len(p) + 1 for p in parts)])
    bounds = np.searchsorted(starts, first_bytes + 1)
    runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + len(runs)]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + 1])
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
