"""Suffix-array dedup over bytes: content-defined shards, each a run-length index.

A shard's run-compressed Burrows-Wheeler transform counts by runs and keeps suffixes sampled at run
ends; segments stream through it, and matches of the window length that also start earlier are marked. See ``repeats``
for how shards are made.

Defined cases: null counts as empty; texts shorter than a window never change; matches never cross documents; an empty
table gives an empty result; rows with equal id and text are one document and get the same answer; other columns are
ignored. A text's bytes may end inside a code point once others are removed, so kept texts are binary.
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
from millrace.llm.repeats import Symbols, covered, mixed, with_spans
from millrace.llm.run_index import RunIndex
from millrace.llm.suffixes import Matches

WINDOW, GRAM = 100, 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bytes(Symbols):
    """Bytes; grams are multiples of eight of them."""

    window: int = WINDOW
    gram: int = GRAM
    index: type[Matches] = RunIndex

    def tidy(self, text: str | None) -> bytes:
        # Zero ends a text; as a byte of a text it takes a value no UTF-8 text has.
        return (text or "").encode("utf-8", "replace").replace(b"\x00", b"\xff")

    def bounds(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        begin = np.arange(len(joined))
        return begin, begin + 1

    def hashes(self, joined: bytes) -> np.ndarray:
        n = len(joined) - self.gram + 1
        out = np.zeros(n, np.uint64)
        for i in range(0, self.gram, 8):
            out = (out ^ (out >> np.uint64(29))) * _ODD + np.ndarray((n,), "<u8", joined, i, (1,))
        return mixed(out)

    def coded(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8), np.fromiter(map(len, segments), np.int64, len(segments))


def dedup_bytes(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without bytes that repeated windows cover."""
    kind = Bytes(window, min(GRAM, window // 8 * 8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                if spans is None:
                    rows.append((len(raw), 0, 0, raw))
                else:
                    gone = covered(spans, len(raw))
                    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    spanned = with_spans(whole_texts(docs), kind, scratch).select("doc_id", "text", "spans")
    return map_pandas(spanned, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without repeated 100-byte strings."""
    found = dedup_bytes(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
