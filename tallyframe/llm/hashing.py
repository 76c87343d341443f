"""Hashes of words and of runs of words, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

# odd multipliers of the run hashes, and their inverses modulo 2**64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; ``trim`` bounds what is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()


class Runs:
    """Hashes of any runs of a word sequence: ``of(begin, end)``."""

    def __init__(self, hashes: np.ndarray, family: int = 0):
        n = len(hashes)
        up = np.full(n + 1, BASES[family], np.uint64)
        down = np.full(n + 1, INVERSES[family], np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        terms = np.zeros(n + 1, np.uint64)
        terms[1:] = (mix(hashes ^ np.uint64(BASES[1])) if family else hashes) * (
            np.multiply.accumulate(up)[:-1]
        )
        self.sums = np.add.accumulate(terms)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(raw + (end - begin).astype(np.uint64) * np.uint64(BASES[1]))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
