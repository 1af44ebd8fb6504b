"""64-bit hashes of words and of runs of words, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the rolling hashes; two lanes give 128 bits.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words whose hashes a task remembers.
CACHE = 500_000


class WordHashes(dict):
    """Word (bytes) -> xxh64 of it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each value."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def runs(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive words, made from runs of 1, 2, 4, ... words by doubling."""
    count = len(words) - n + 1
    if count <= 0:
        return words[:0]
    base = LANES[lane]
    part, size, out, done = mixed(words + np.uint64(lane)), 1, None, 0
    while True:
        if n & size:
            piece = part[done : done + count] if out is not None else part[:count]
            out = piece if out is None else out * np.uint64(pow(base, size, 1 << 64)) + piece
            done += size
        if size * 2 > n:
            return mixed(out)
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def digest(data: bytes) -> tuple[int, int]:
    """128 bits as two signed 64-bit integers."""
    d = xxhash.xxh128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
