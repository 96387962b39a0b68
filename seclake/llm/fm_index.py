"""A compressed full-text index over numbers: backward search on a wavelet tree of packed bit rows."""

from __future__ import annotations

import numpy as np


class BitRow:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks of numbers in a sequence, one packed row of bits for each bit of the numbers (levels laid out as a matrix)."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.depth = max(1, int(top).bit_length())
        self.rows = []
        for level in range(self.depth - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            self.rows.append(BitRow(bits))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

        self.starts = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions of the sequence come to lie in the last row's order, on the path of each value."""
        for level, row in enumerate(self.rows):
            ones = row.ones(at)
            at = np.where(value >> (self.depth - 1 - level) & 1, row.zeros + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before its position."""
        return self._down(value, at) - self.starts[value]


class FmIndex:
    """Where words of numbers occur in a text of numbers, for patterns of at most `longest`.

    Suffixes are sorted by their first `longest` numbers only, by doubling the compared length; backward search looks
    no deeper than the pattern, so its ranges are those of the full order. Numbers are from 1; 0 separates
    texts and is in no pattern.
    """

    def __init__(self, text: np.ndarray, longest: int) -> None:
        rank, known = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while known < longest:
            step = min(known, longest - known)
            rank, order = _paired(rank, step)
            known += step
        self.size, self.order = len(text), order
        #: For each position in the order, the first position of its equal prefixes.
        self.group = rank[order]
        self.tree = WaveletTree(text[order - 1], int(text.max(initial=0)))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1))])

    def search(self, pattern_end: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the order that begin with the `length` numbers of `text` up to each end (included)."""
        last = text[pattern_end]
        low, high = self.before[last], self.before[last + 1]
        for back in range(1, length):
            number = text[pattern_end - back]
            low, high = self.before[number] + self.tree.rank(number, low), self.before[number] + self.tree.rank(number, high)
        return low, high


def _paired(rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by (rank, rank `step` further on), equal pairs sharing the first position of theirs; and the order."""
    later = np.zeros(len(rank), np.int64)
    later[: len(rank) - step] = rank[step:] + 1
    key = rank * (len(rank) + int(rank.max(initial=0)) + 2) + later
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    firsts = np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))
    out = np.empty(len(rank), np.int64)
    out[order] = firsts
    return out, order
