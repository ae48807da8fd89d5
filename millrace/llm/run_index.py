"""Run-length index: a run-compressed Burrows-Wheeler transform with samples at run ends.

Runs are cut where a wide group begins, so that the first end of a group's first run is the group's earliest suffix: places come
from these samples. An interval that lies in one run moves with it: where a run's first place goes, and in which run that lies, is kept, so that no count
is needed; other intervals count by the runs of their symbol. For r runs and g wide groups an index holds 40 r + 12 g bytes, whatever
the text's length: copies of a sequence make runs longer, not more.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.suffixes import Matches

#: Runs that a moved place is followed over one by one.
NEAR = 3


class RunIndex(Matches):
    """Counts come from the runs of each symbol, places from suffixes sampled at the runs' first ends. The hint of a place is its run."""

    def build(self, bwt: np.ndarray, order: np.ndarray, at: np.ndarray, groups: np.ndarray) -> None:
        fresh = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        fresh[groups] = True
        first = np.flatnonzero(fresh)
        self.samples = order[first].astype(np.int32)
        self.run = np.searchsorted(first, groups).astype(np.int32)
        self.heads = np.append(at[first], self.n).astype(np.int32)
        lengths = np.diff(self.heads)
        self.symbols = bwt[first].astype(np.int32)
        by_symbol = np.argsort(self.symbols, kind="stable")
        self.keys = self.symbols[by_symbol] * np.int64(self.n + 1) + self.heads[by_symbol]
        self.lengths = lengths[by_symbol]
        # Runs of smaller symbols count in full before those of a symbol, as in ``before``.
        self.seen = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.moved = np.empty_like(self.seen)
        self.moved[by_symbol] = self.seen
        self.into = self._runs(self.moved)
        self.group = (np.searchsorted(self.start, self.heads[:-1], "right") - 1).astype(np.int32)

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """The runs that places lie in."""
        return (np.searchsorted(self.heads[:-1], at.astype(np.int32), "right") - 1).astype(np.int32)

    def count(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = symbol * (self.n + 1) + at
        run = np.searchsorted(self.keys, key, "right") - 1
        own = run >= 0
        run = np.maximum(run, 0)
        into = key - self.keys[run]
        length = self.lengths[run]
        before = self.seen[run] + np.minimum(into, length) - self.before[symbol]
        return np.where(own, before, 0), own & (into < length)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new_low = self.moved[hint] + (low - self.heads[hint])
        new_high = new_low + (high - low)
        run = self.into[hint]
        apart = np.flatnonzero((self.symbols[hint] != symbol) | (high > self.heads[hint + 1]))
        if len(apart):
            new_low[apart], new_high[apart], _ = super().step(symbol[apart], low[apart], high[apart], hint[apart])
            run[apart] = self._runs(new_low[apart])
        for _ in range(NEAR):
            past = new_low >= self.heads[run + 1]
            if not past.any():
                return new_low, new_high, run
            run = np.minimum(run + past, len(self.symbols) - 1)
        past = np.flatnonzero(new_low >= self.heads[run + 1])
        run[past] = self._runs(new_low[past])
        return new_low, new_high, run

    def groups(self, at: np.ndarray, hint: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.full(len(at), -1)
        found = self.group[hint]
        return np.where((found >= 0) & (at < self.end[found]), found, -1)

    def hints(self, group: np.ndarray) -> np.ndarray:
        return self.run[group]

    def earliest(self, group: np.ndarray) -> np.ndarray:
        return self.samples[self.run[group]].astype(np.int64)
