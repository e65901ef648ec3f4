"""Hashes of words and lines, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

MOST = 1 << 17


def line_hash(line: bytes) -> int:
    """64 bits as a signed number."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


class WordHashes(dict):
    """64-bit hashes of words. Those seen are remembered, up to a bound, then all are forgotten."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
