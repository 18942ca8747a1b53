"""Vectorised 64-bit hashes of words and word runs, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Different words a worker remembers; the memory is emptied when full.
CACHED_WORDS = 400_000


class WordHashes(dict):
    """Hash of each word (UTF-8 bytes), computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two xor-multiply rounds)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words; empty if there are fewer words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, length):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[j : j + n]
    return mix(total)


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words; a shorter text with a word is one shingle."""
    return runs(hashes, min(length, max(1, len(hashes))))
