"""Exact byte-level BPE token counts by rank-synchronous merging of ragged arrays.

Pre-tokens wait in batches: all their bytes stand in one array of symbols beside an array of
sequence numbers. Each round finds every sequence's lowest-rank pair, applies it at all its places
at once and drops sequences without a known pair; what survives is counted.

Defined cases: null text counts as empty (0 bytes, 0 tokens); texts are never cut; strings of
special tokens inside a text are single tokens, as the vocabulary's library has it; lone surrogates
count as their replacement. Repeated rows are answered each for themselves.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from millrace.functions.workers import map_pandas
from millrace.llm.common import table, whole_texts

#: The pre-token pattern of this vocabulary's byte-level splitter.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Entries of a worker's memory of counted pieces, and code points handled at once.
REMEMBERED, AT_ONCE = 1_000_000, 1 << 20
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Symbols, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        shown = self._shown_bytes()
        self.of_byte = np.array([ids[shown[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
        plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        return [chr(b if b in plain else next(spare)) for b in range(256)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, or the largest integer."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece when all merges are done."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        if len(symbols) < 2:
            return counts
        # ranks[i]: of the pair that begins at i, none at a sequence's end.
        ranks = np.append(self.rank(symbols[:-1], symbols[1:]), _NONE)
        ranks[:-1][owner[1:] != owner[:-1]] = _NONE
        while True:
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(ranks, starts)
            hits = np.flatnonzero((ranks == np.repeat(best, sizes)) & (ranks != _NONE))
            if not len(hits):
                return counts
            # In a run of equal symbols pairs overlap: every second one is taken.
            fresh = np.concatenate(([True], np.diff(hits) != 1))
            first = np.maximum.accumulate(np.where(fresh, hits, 0))
            hits = hits[(hits - first) % 2 == 0]
            counts -= np.bincount(owner[hits], minlength=len(counts))
            symbols[hits] = self.merged[ranks[hits]]
            changed = np.zeros(len(symbols), bool)
            changed[hits] = True
            keep = np.repeat(best != _NONE, sizes)
            keep[hits + 1] = False
            symbols, owner, ranks, changed = symbols[keep], owner[keep], ranks[keep], changed[keep]
            changed[:-1] |= changed[1:]
            ranks[changed] = _NONE
            at = np.flatnonzero(changed[:-1])
            ranks[at] = np.where(owner[at] == owner[at + 1], self.rank(symbols[at], symbols[at + 1]), _NONE)


class Counter:
    """Token counts of texts, remembering the counts of pieces between spaces."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, int] = {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.spaces = regex.compile(r"\s\s")
        self.runs = regex.compile(r"\s*\S+|\s+")
        self.special = regex.compile("|".join(map(regex.escape, self.vocabulary.special))) if self.vocabulary.special else None

    def pieces(self, text: str) -> list[str]:
        """Parts of a text no pre-token crosses."""
        if not text:
            return []
        if self.spaces.search(text):
            return self.runs.findall(text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)] if head else [" " + x for x in rest]

    def learn(self, pieces: set[str]) -> None:
        """Counts pieces that are not yet known."""
        fresh = [p for p in pieces if p not in self.known]
        whole = [p for p in fresh if p.isalpha() or (p[0] == " " and p[1:].isalpha())]  # one pre-token each
        alone = set(whole)
        split = {p: self.pattern.findall(p) for p in fresh if p not in alone}
        parts = [*whole, *({x for found in split.values() for x in found} - alone - self.known.keys())]
        if parts:
            self.known.update(zip(parts, self.vocabulary.count([p.encode("utf-8", "replace") for p in parts]).tolist(), strict=True))
        get = self.known.__getitem__
        self.known.update([(p, sum(map(get, found))) for p, found in split.items()])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            between = self.special.split(text) if self.special else [text]
            totals[i] += len(between) - 1
            parts += [(i, self.pieces(x)) for x in between]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn({p for _, found in parts for p in found})
        for i, found in parts:
            totals[i] += sum(map(self.known.__getitem__, found))
        return totals


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _together(texts: list[str]) -> Iterator[list[str]]:
    """Groups of texts of about ``AT_ONCE`` code points."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > AT_ONCE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text of (doc_id, text); ``over_limit`` if more tokens than ``limit``.

    vocabulary: a file that workers can open; by default each worker looks up its own machine's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary or vocabulary_path())
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            counts = np.array([n for group in _together(texts) for n in counter.count(group)], np.int64)
            size = np.fromiter((len(t.encode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": size, "n_tokens": counts, "over_limit": counts > limit})

    return map_pandas(whole_texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
