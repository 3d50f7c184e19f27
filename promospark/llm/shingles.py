"""64-bit hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from promospark.llm.common import Remembered

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word; one to one."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(Remembered):
    """Hashes of the words met lately."""

    def __init__(self, bound: int = 300_000):
        super().__init__(bound)

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, text: bytes) -> np.ndarray:
        """Of the words of ``text`` with A-Z lower-cased, in order."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole where it is shorter."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    rolled = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        rolled = mixed(rolled ^ words[k:n - size + 1 + k])
    return np.unique(rolled)


def set_hash(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))
