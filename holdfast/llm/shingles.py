"""Hashed word shingles in Python workers, shared by the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a task remembers; the store is emptied when full.
REMEMBERED = 400_000


class WordHashes(dict):
    """The 64-bit hash of a word given as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, element by element."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For windows of up to 31 words.
PLACES = multipliers(32, 5)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; with fewer words, one for the whole sequence; none for no words."""
    n, m = len(hashes), PLACES
    if not n:
        return hashes
    if n < k:
        return mix((hashes * m[:n]).sum(dtype=np.uint64, keepdims=True) + m[k : k + 1] * np.full(1, n, np.uint64))
    out = hashes[: n - k + 1] * m[0]
    for j in range(1, k):
        out += hashes[j : n - k + 1 + j] * m[j]
    return mix(out)


def shingle_set(text: str | None, cache: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased, words split at space and \\x09-\\x0D."""
    return np.unique(windows(cache.of((text or "").encode("utf-8", "surrogatepass").lower().split()), k))
