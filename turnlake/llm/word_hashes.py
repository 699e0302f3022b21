"""Hashes of words and of runs of words, over arrays."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words whose hashes a task remembers.
REMEMBERED = 200_000

#: Odd, so that they have inverses modulo 2 ** 64.
_WORD, _OTHER = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


class WordHashes(dict):
    """The first 64 bits of words' MD5; forgets all when it gets too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")
        return h


def power(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2 ** 64, at least; n may be 0."""
    if base not in _powers or len(_powers[base]) < n:
        each = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        each[0] = 1
        _powers[base] = np.multiply.accumulate(each)
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD) -> np.ndarray:
    """Polynomial hashes of runs of values, whatever their places."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power(base, len(values))[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * power(pow(base, -1, 1 << 64), len(values) + 1)[starts])


def hashed_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends again, and both halves of the runs' hashes."""
    return starts, ends, runs(values, starts, ends), runs(mixed(values), starts, ends, _OTHER)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values (below 2 ** 32) stands, of equal ones the last."""
    last = np.int64((1 << 31) - 1)
    key, done = (values.astype(np.int64) << np.int64(31)) | (last - np.arange(len(values), dtype=np.int64)), 1
    while done < width:
        step = min(done, width - done)
        key, done = np.minimum(key[:-step], key[step:]), done + step
    return last - (key & last)
