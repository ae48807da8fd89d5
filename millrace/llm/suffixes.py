"""Backward search over a block of sequences, to a fixed depth.

Suffixes are ordered by their first ``depth`` symbols, those alike in them by their place in the text. Suffixes alike in ``depth`` symbols are a
group; a wide group has two members at least. Backward search is exact for patterns of up to ``depth`` symbols: as soon as
a pattern has them all, its interval is widened to its group (the parent interval), in which the next symbol's interval lies.

The suffix array and the transform are needed for building only. What stays is the index of the transform, of
which the two kinds of index keep different forms, the bounds of wide groups and the suffix that each starts with: its earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by their keys of so many bits, equal keys by place, and the keys in that order."""
    width = len(keys).bit_length()
    if bits + width < 64:  # key and place in one number: no indirect sort
        packed = np.sort(keys << width | np.arange(len(keys)))
        return packed & ((1 << width) - 1), packed >> width
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """values[i + by], 0 beyond the end."""
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` symbols and by place, and where in that order groups start.

    symbols: positive integers; 0 separates sequences. Ranks of ever longer beginnings are made from those of shorter ones.
    """
    if symbols.dtype == np.uint8 and depth >= 5:
        padded = np.concatenate((symbols, np.zeros(8, np.uint8)))
        keys, reach = np.ndarray((len(symbols),), ">u8", padded.tobytes(), 0, (1,)).astype(np.int64) >> 24 & 0xFFFFFFFFFF, 5
    else:
        keys, reach = symbols.astype(np.int64), 1
    while True:
        order, ordered = _sorted(keys, int(keys.max(initial=0)).bit_length())
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(order)]
        if reach >= depth:
            return order, np.flatnonzero(fresh)
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(fresh) - 1
        more = min(reach, depth - reach)
        keys = ranks << int(fresh.sum()).bit_length() | _ahead(ranks, more)
        reach += more


class Matches:
    """What both indexes share: the text's symbol counts, and bounds of the wide groups.

    A sequence may stand in the text several times. Suffixes of its copies are neighbours in the order, so that it is sorted once and
    each of its suffixes takes as many places of the order and of the transform as there are copies.
    """

    def __init__(self, symbols: np.ndarray, depth: int, copies: np.ndarray | None = None) -> None:
        """copies: for each symbol, how often its sequence stands in the text; once if not given."""
        order, starts = suffix_order(symbols, depth)
        copies = np.ones(len(symbols), np.int64) if copies is None else copies
        at = np.concatenate(([0], np.cumsum(copies[order])))
        self.n, self.depth = int(at[-1]), depth
        start, end = at[starts], at[np.append(starts[1:], len(order))]
        wide = end - start > 1
        self.start, self.end = start[wide].astype(np.int32), end[wide].astype(np.int32)
        counts = np.bincount(symbols, copies).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)
        self.build(symbols[order - 1], order, at, starts[wide])  # the last symbol is a separator, and stands before the first

    def build(self, bwt: np.ndarray, order: np.ndarray, at: np.ndarray, groups: np.ndarray) -> None:
        """Keeps what ``count`` and ``earliest`` need of the transform and the suffix array.

        bwt and order: without copies. at: the first place of each suffix with its copies. groups: which suffixes begin wide groups.
        """
        raise NotImplementedError

    def count(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands in the transform before each place, and whether it stands there."""
        raise NotImplementedError

    def earliest(self, group: np.ndarray) -> np.ndarray:
        """Where in the text the first suffix of wide groups begins."""
        raise NotImplementedError

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals with a symbol more before them. ``hint`` is what an index likes to know of ``low``."""
        # An interval of one suffix goes on with the symbol before it: one count will do.
        wide = np.flatnonzero(high - low > 1)
        before, here = self.count(np.concatenate((symbol, symbol[wide])), np.concatenate((low, high[wide])))
        first = self.before[symbol]
        new_low = first + before[: len(low)]
        new_high = new_low + here[: len(low)]
        new_high[wide] = first[wide] + before[len(low) :]
        return new_low, new_high, hint

    def groups(self, at: np.ndarray, hint: np.ndarray) -> np.ndarray:
        """The wide group that each place of the order lies in, or -1."""
        found = np.searchsorted(self.start, at, "right") - 1
        return np.where((found >= 0) & (at < self.end[found]), found, -1) if len(self.start) else np.full(len(at), -1)

    def hints(self, group: np.ndarray) -> np.ndarray:
        """The hints of wide groups' starts."""
        return np.zeros(len(group), np.int64)

    def stream(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of sequences that the index holds, from right to left, all sequences at once.

        Gives (which, place, group): from ``place`` on, the sequences ``which`` match the suffixes of a wide group in ``depth`` symbols.
        """
        at = ends - 1
        low, high, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.n), np.zeros(len(starts), np.int64)
        hint = np.zeros(len(starts), np.int64)
        live = np.flatnonzero(at >= starts)
        while len(live):
            low[live], high[live], hint[live] = self.step(symbols[at[live]].astype(np.int64), low[live], high[live], hint[live])
            length[live] += 1
            full = live[length[live] >= self.depth]
            if len(full):
                group = self.groups(low[full], hint[full])
                met = group >= 0
                full, group = full[met], group[met]
                low[full], high[full], hint[full] = self.start[group], self.end[group], self.hints(group)
                yield full, at[full], group
            at[live] -= 1
            live = live[at[live] >= starts[live]]
