"""FM-index over words: a Burrows-Wheeler transform held in a wavelet matrix, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (_U(1) << (i & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a text of symbols 1 .. sigma - 1, with 0 between its parts.

    Suffixes are ordered by their first ``depth`` symbols at least, which is all that patterns of up to
    ``depth`` symbols need.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < depth:
            after = np.zeros(n, np.int64)
            after[:-step or None] = rank[step:] + 1 if step < n else 0
            pair = rank * (max(int(rank.max(initial=0)), n) + 2) + after
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, bool)
            new[:1] = True
            new[1:] = pair[order[1:]] != pair[order[:-1]]
            rank[order] = np.cumsum(new) - 1
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)
        bwt = text[self.suffixes - 1] if n else text
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels, symbols, current = [], np.arange(sigma), bwt
        start = np.zeros(sigma, np.int64)
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            vector = Bits(bit)
            own = ((symbols >> level) & 1).astype(bool)
            ones = vector.rank(start)
            start = np.where(own, vector.zeros + ones, start - ones)
            self.levels.append((level, vector))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.start = start

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: rows of the suffixes that have ``symbol`` before those of rows low .. high - 1."""
        m = len(symbol)
        place = np.concatenate([low, high])
        both = np.concatenate([symbol, symbol])
        for level, vector in self.levels:
            ones = vector.rank(place)
            place = np.where((both >> level) & 1, vector.zeros + ones, place - ones)
        place = place - self.start[both] + self.first[both]
        return place[:m], place[m:]

    def intervals(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin like ``text[s : s + length]``, for every s in ``starts``."""
        last = text[starts + length - 1]
        low, high = self.first[last], self.first[last + 1]
        for back in range(length - 2, -1, -1):
            low, high = self.step(text[starts + back], low, high)
        return low, high
