"""Words of UTF-8 texts in arrays: where they begin and end, and 64-bit hashes of words and shingles.

A word is a run of bytes other than ASCII white space; ASCII letters count as lower case.
"""

from __future__ import annotations

import numpy as np

BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to ``n`` at least."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) and hashes of the words of a text."""
    x = np.frombuffer(data.lower(), np.uint8)
    word = np.zeros(len(x) + 2, np.int8)
    word[1:-1] = IS_WORD[x]
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverses = _power_tables(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x.astype(np.uint64) * powers[: len(x)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mixed(out)
