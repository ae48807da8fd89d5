"""FM-index whose occurrence counts come from a wavelet matrix of compressed bits.

Each level of the matrix is a bit vector cut into words of 64 bits. Words of equal bits, which are most where a text repeats itself,
are told by the counts at word ends and not stored. Of the suffix array one place for each wide group is kept.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.suffixes import Matches

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _below(at: np.ndarray) -> np.ndarray:
    """Masks of the bits below each place of a word."""
    return (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)


class _Bits:
    """A bit vector: counts at word ends, and the words whose bits differ."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little").view(np.uint64)
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.int32)
        mixed = (words != 0) & (words != _FULL)
        self.words = np.append(words[mixed], np.uint64(0))
        # Which words are stored, as bits with counts of their own.
        self.kinds = np.packbits(np.concatenate((mixed, np.zeros(-len(mixed) % 64, bool))), bitorder="little").view(np.uint64)
        self.stored = np.concatenate(([0], np.cumsum(np.bitwise_count(self.kinds), dtype=np.int64))).astype(np.int32)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there."""
        word = at >> 6
        ones = self.ones[word]
        kind = self.kinds[word >> 6]
        stored = (kind >> (word & 63).astype(np.uint64)) & np.uint64(1)
        slot = self.stored[word >> 6] + np.bitwise_count(kind & _below(word))
        bits = np.where(stored, self.words[slot * stored.astype(np.int32)], np.where(self.ones[word + 1] > ones, _FULL, np.uint64(0)))
        return ones + np.bitwise_count(bits & _below(at)), (bits >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FmIndex(Matches):
    """Backward search over a wavelet matrix: one bit vector for each bit of a symbol."""

    def build(self, bwt: np.ndarray, order: np.ndarray, at: np.ndarray, groups: np.ndarray) -> None:
        self.places = order[groups].astype(np.int32)
        bwt = np.repeat(bwt, np.diff(at))
        self.levels, self.zeros = [], []
        size = max(1, int(bwt.max(initial=0)).bit_length())
        self.shifts = range(size - 1, -1, -1)
        for shift in self.shifts:
            bits = (bwt >> shift & 1).astype(bool)
            self.levels.append(_Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            bwt = np.concatenate((bwt[~bits], bwt[bits]))
        every = np.arange(len(self.before))
        self.origin = self._descend(every, np.zeros(len(every), np.int64))[0].astype(np.int32)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = np.ones(len(at), bool)
        for shift, bits, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones, bit = bits.look(at)
            one = symbol >> shift & 1
            here &= bit == one.astype(np.uint64)
            at = np.where(one, zeros + ones, at - ones)
        return at, here

    def count(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, here = self._descend(symbol, at)
        return at - self.origin[symbol], here

    def earliest(self, group: np.ndarray) -> np.ndarray:
        return self.places[group].astype(np.int64)

    def size(self) -> int:
        """Bytes of the compressed matrix."""
        return sum(a.nbytes for b in self.levels for a in (b.ones, b.words, b.kinds, b.stored))
