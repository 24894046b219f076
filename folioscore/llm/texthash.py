"""Hashes of words and of character n-grams of a text, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PIECE = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base % 2**64, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text whose words are parted by spaces (32)."""
    out, start = [], 0
    while start < len(data):
        end = len(data) if start + _PIECE >= len(data) else data.find(b" ", start + _PIECE)
        end = len(data) if end < 0 else end
        a = np.frombuffer(data, np.uint8, end - start, start)
        inside = np.concatenate([[False], a != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        up, down = _tables(len(a))
        sums = np.concatenate(
            [np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)]
        )
        first, last = edges[::2], edges[1::2]
        out.append(mix((sums[last] - sums[first]) * down[first]))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)
