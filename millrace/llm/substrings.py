"""Substring dedup over words: content-defined shards, each an FM-index over a wavelet matrix.

Documents stream through their shards' indexes by backward search; matching statistics above
the window length report the intervals that repeat. See ``repeats`` for how shards are made.

Defined cases: null and empty texts have no words; words are cut at ASCII white space only and compared unchanged; a
text of fewer words than a window never changes; an empty table gives an empty result; rows with equal id and text are
one document and get the same answer; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_pandas
from millrace.llm.common import Scratch, table, whole_texts
from millrace.llm.fm_index import FmIndex
from millrace.llm.repeats import Symbols, covered, mixed, with_spans
from millrace.llm.suffixes import Matches

WINDOW, GRAM = 20, 5
_rng = np.random.default_rng(20)
#: A random value for each byte, and powers of an odd base with their inverses modulo 2 ** 64.
_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[bytes]:
    """A text's words as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from prefix sums of a polynomial."""
    raw = np.frombuffer(joined, np.uint8)
    power = np.full(len(raw), _BASE, np.uint64)
    back = np.full(len(raw), _INVERSE, np.uint64)
    power[:1] = back[:1] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * power)))
    return mixed((sums[end] - sums[begin]) * back[begin])


@dataclass(frozen=True)
class Words(Symbols):
    """Words, joined by single spaces."""

    window: int = WINDOW
    gram: int = GRAM
    index: type[Matches] = FmIndex

    def tidy(self, text: str | None) -> bytes:
        # A zero byte inside a word would look like a text's end; it takes a value no UTF-8 text has.
        return b" ".join(words(text)).replace(b"\x00", b"\xff")

    def bounds(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(joined, np.uint8)
        stop = np.flatnonzero((raw == 32) | (raw == 0))
        begin = np.concatenate(([0], stop[:-1] + 1))
        # A text's end is a symbol of its own: its zero byte.
        last = raw[stop] == 0
        begin, end = np.repeat(begin, 1 + last), np.repeat(stop, 1 + last)
        ends = np.cumsum(1 + last)[last] - 1
        begin[ends], end[ends] = stop[last], stop[last] + 1
        keep = end > begin  # an empty text has its end only
        return begin[keep], end[keep]

    def hashes(self, joined: bytes) -> np.ndarray:
        begin, end = self.bounds(joined)
        h = word_hashes(joined, begin, end)
        n = len(h) - self.gram + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.gram):
            out = out * np.uint64(_BASE) + h[i : i + n]
        return mixed(out)

    def coded(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [s.split(b" ") for s in segments]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers: dict[bytes, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for s in split for w in s), np.int64)
        symbols = np.zeros(len(codes) + len(split), np.int64)
        symbols[np.arange(len(codes)) + np.repeat(np.arange(len(split)), sizes)] = codes
        return symbols, sizes


def dedup_words(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without words that repeated windows cover, joined by single spaces."""
    kind = Words(window, min(GRAM, window))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                found = words(text)
                if spans is None:
                    rows.append((len(found), 0, b" ".join(found).decode("utf-8", "replace")))
                else:
                    gone = covered(spans, len(found))
                    rows.append((len(found), int(gone.sum()), b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g]).decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    spanned = with_spans(whole_texts(docs), kind, scratch).select("doc_id", "text", "spans")
    return map_pandas(spanned, run, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without repeated 20-word windows."""
    found = dedup_words(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
