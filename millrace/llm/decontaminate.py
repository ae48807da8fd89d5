"""Benchmark decontamination by the q-gram lemma: diagonal bands, an edit budget, banded alignment.

An item of m bytes within e edits of a text region shares at least m + 1 - (e + 1) q of its q-grams
with it, on at most 2 e + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals;
a band that holds enough of them is aligned within its diagonals, and kept if the edits stay in the budget. An item's budget is ``rate``
edits for each byte, whatever its size; short items take a shorter q, so that the lemma asks for one shared gram at least. Items
without a single edit allowed are found unchanged only, and those of less than ``WORDS_BELOW`` bytes as whole words only.

Texts and items are compared lower-cased, with each run of white space as one space, as UTF-8 bytes.
Defined cases: null and empty texts match nothing; null and empty items never match; null ids, of documents and of items, are answered
as null; repeated rows, of equal or different texts, are answered each for themselves; other columns of both tables are ignored; empty tables give an empty
result. Texts of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_pandas
from millrace.llm.common import table, whole_texts

#: Bytes of a gram at most, and edits for each byte of an item.
Q, RATE = 12, 0.07
#: Bytes under which an item must stand as whole words.
WORDS_BELOW = 12
#: Bytes of items that are sent to executors at once; a larger benchmark is compared in several passes.
SLICE_BYTES = 8 << 20
#: Bytes of text compared at once.
AT_ONCE = 2 << 20
#: Shared q-grams looked at at once; a common gram stands in many items.
PIECE = 4 << 20
_BITS = 24
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> bytes:
    """Lower case, single spaces."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def _word(byte: bytes) -> bool:
    """Whether a byte belongs to a word: letters, digits, anything beyond ASCII."""
    return byte.isalnum() or byte > b"\x7f"


def _grams(raw: bytes, q: int) -> np.ndarray:
    """A 64-bit code of the q bytes from each position (q up to 16)."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q < 8:
        return np.ndarray((n,), "<u8", raw + b"\x00" * 8, 0, (1,)) & np.uint64((1 << 8 * q) - 1)
    head = np.ndarray((n,), "<u8", raw, 0, (1,))
    tail = np.ndarray((n,), "<u8", raw, q - 8, (1,))
    return (head * _ODD) ^ ((tail * _MIX) >> np.uint64(7)) ^ (tail << np.uint64(9))


def budget_of(size: int, rate: float) -> int:
    """Edits allowed for an item of ``size`` bytes."""
    return int(size * rate)


def gram_of(size: int, q: int, rate: float) -> int:
    """Bytes of the grams of an item: no more than leave one shared gram within the budget."""
    return max(1, min(q, size // (budget_of(size, rate) + 1)))


class Index:
    """Where each q-gram stands in the items, which share their q."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float) -> None:
        self.q, self.ids, self.raw = q, [i for i, _ in items], [x for _, x in items]
        size = np.array([len(x) for x in self.raw], np.int64)
        self.budget = np.array([budget_of(n, rate) for n in size.tolist()], np.int64)
        self.need = np.maximum(1, size + 1 - (self.budget + 1) * q)
        found = [_grams(x, q) for x in self.raw]
        codes = np.concatenate(found) if found else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.times = np.unique(codes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.slot(self.codes)] = True
        self.least = int(self.need.min()) if len(items) else 1

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _ODD >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first diagonal, shared q-grams) of bands that hold enough."""
        joined = b"\x00".join(texts) + b"\x00" * 16
        codes = _grams(joined, self.q)
        at = np.flatnonzero(self.seen[self.slot(codes)])
        known = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[known] == codes[at]
        at, known = at[hit], known[hit]
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, at, "right")
        busy = np.bincount(text, minlength=len(texts) + 1) >= self.least
        at, known, text = at[busy[text]], known[busy[text]], text[busy[text]]
        if not len(at):
            return
        if int(self.times[known].sum()) <= PIECE:
            yield from self._bands(at, known, text, ends, texts, None)
            return
        # A common gram stands in many items: text by text, items that share too few grams with it go first.
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        for a, b in zip(first.tolist(), np.append(first[1:], len(text)).tolist(), strict=True):
            shared = np.zeros(len(self.ids), np.int64)
            for entry, _ in self._entries(known[a:b]):
                shared += np.bincount(self.item[entry], minlength=len(self.ids))
            yield from self._bands(at[a:b], known[a:b], text[a:b], ends, texts, shared >= self.need)

    def _entries(self, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where known grams stand in items, in pieces: (entry, which of the known)."""
        times = self.times[known]
        till = np.cumsum(times)
        at = 0
        while at < len(known):
            stop = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + PIECE, "right")))
            n = times[at:stop]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(self.first[known[at:stop]], n) + step, np.repeat(np.arange(at, stop), n)
            at = stop

    def _bands(self, at: np.ndarray, known: np.ndarray, text: np.ndarray, ends: np.ndarray, texts: list[bytes], chosen: np.ndarray | None) -> Iterator[tuple[int, int, int, int]]:
        shift = (2 * int(self.budget.max()) + 1) * 2 + max(map(len, self.raw))
        parts = []
        for entry, which in self._entries(known):
            if chosen is not None:
                keep = chosen[self.item[entry]]
                entry, which = entry[keep], which[keep]
            item = self.item[entry]
            band = (at[which] - self.place[entry] + shift) // (2 * self.budget[item] + 1)
            # Each band also takes the diagonals of the next: any 2 e + 1 neighbours lie in one band.
            here = np.stack((text[which], item, band))
            parts.append(np.unique(np.concatenate((here, here - [[0], [0], [1]]), axis=1), axis=1, return_counts=True) if chosen is not None else (np.concatenate((here, here - [[0], [0], [1]]), axis=1), None))
        rows = np.concatenate([r for r, _ in parts], axis=1)
        weight = np.concatenate([np.ones(r.shape[1], np.int64) if n is None else n for r, n in parts])
        if not rows.shape[1]:
            return
        order = np.lexsort(rows[::-1])
        rows, weight = rows[:, order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0))))
        counts = np.add.reduceat(weight, starts)
        enough = counts >= self.need[rows[1, starts]]
        for (t, i, b), n in zip(rows[:, starts[enough]].T.tolist(), counts[enough].tolist(), strict=True):
            yield t, i, int(b * (2 * self.budget[i] + 1) - shift - (ends[t] - len(texts[t]) - 1)), n

    def align(self, text: bytes, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item's best alignment on the band's diagonals, if within the budget."""
        raw, budget = self.raw[item], int(self.budget[item])
        low, width = diagonal - budget, 2 * (2 * budget + 1) + 2 * budget
        start = max(0, low)
        exact = text.find(raw, start, max(start, low + width + len(raw)))
        while exact >= 0:
            if len(raw) >= WORDS_BELOW or not (_word(text[exact - 1 : exact]) or _word(text[exact + len(raw) : exact + len(raw) + 1])):
                return 0, exact, exact + len(raw)
            exact = text.find(raw, exact + 1, max(start, low + width + len(raw)))
        if not budget:
            return None
        # Cell d of a row: on diagonal low + d. A text begins and ends anywhere: outside it nothing matches.
        padded = np.full(width + len(raw), 256, np.int16)
        inside = np.frombuffer(text[start : max(start, low + width + len(raw))], np.uint8)
        padded[start - low : start - low + len(inside)] = inside
        pattern, ramp = np.frombuffer(raw, np.uint8), np.arange(width)
        cost, origin = np.zeros(width, np.int64), ramp.copy()
        scale = 1 << 20
        packed = cost * scale + origin
        for i, byte in enumerate(pattern):
            diagonal_step = packed + (padded[i : i + width] != byte) * scale
            up = np.append(packed[1:] + scale, np.iinfo(np.int64).max // 2)
            packed = np.minimum(diagonal_step, up)
            packed = np.minimum.accumulate(packed - ramp * scale) + ramp * scale
        d = int(np.argmin(packed))
        edits, begin = divmod(int(packed[d]), scale)
        return (edits, max(0, low + begin), min(len(text), low + d + len(raw))) if edits <= budget else None

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): the best region of each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, diagonal, _ in self.regions(texts):
            if best.get((t, i), (1,))[0] and (found := self.align(texts[t], i, diagonal)):
                best[t, i] = min(best.get((t, i), found), found)
        for (t, i), found in sorted(best.items()):
            yield t, i, *found


def indexes(items: list[tuple[int, bytes]], q: int, rate: float) -> list[Index]:
    """An index for each size of grams that the items take."""
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for item in items:
        by_size.setdefault(gram_of(len(item[1]), q, rate), []).append(item)
    return [Index(found, size, rate) for size, found in sorted(by_size.items())]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, normalised, in slices of about ``SLICE_BYTES``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // SLICE_BYTES + 1
    for n in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n)
        found = sorted(((r.item_id, normal(r.text)) for r in part.toLocalIterator()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if found := [x for x in found if x[1]]:
            yield found


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, start_byte, end_byte, passage): items found in documents.

    One row for each document row and item, of the region with the fewest edits; places are in the normalised text.
    ``rate``: edits allowed for each byte of an item.
    """
    schema = "doc_id long, item_id long, edits long, start_byte long, end_byte long, passage string"
    spark, texts = docs.sparkSession, whole_texts(docs)
    out = None
    for items in _slices(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            made = indexes(sent.value, q, rate)
            for batch in batches:
                rows = []
                for ids, group in _groups(batch):
                    for index in made:
                        for t, i, edits, start, end in index.matches(group):
                            rows.append((ids[t], index.ids[i], edits, start, end, group[t][start:end].decode("utf-8", "replace")))
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start_byte", "end_byte", "passage"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        found = map_pandas(texts, run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _groups(batch: pd.DataFrame) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
        raw = normal(text)
        ids.append(None if pd.isna(doc_id) else int(doc_id))
        texts.append(raw)
        size += len(raw)
        if size > AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
