"""Line dedup with a log-template tree of fixed depth.

Lines are parsed by their number of tokens and their leading tokens (tokens with digits count as
variable fields); under each leaf, lines alike in at least ``alike`` of their tokens share a
template whose differing tokens become fields. Lines of fewer than ``min_tokens`` tokens are told from chance by all their tokens only: each
is a template of its own, without fields.

A leaf is parsed whole, whatever its size: each of its lines is held against all templates so far. Beyond ``CROWD`` templates those that can be
alike enough are looked up by the tokens at their places; the rest would fall short, so that only the work depends on it.

A template recurs if at least ``min_docs`` documents that are different texts have it, and at least one in ``NOISE`` of the texts with it is one: copies and
near-copies of one document are no boilerplate. What a document is beside a line is told by ``SKETCH`` least hashes of the word shingles
in its other lines; for each of these the first document with it stands for all, and one that stands for itself in half of them is a
different text. (Of near-copies of Jaccard 0.8, seven in a thousand pass for different, of documents that share half of what stands
beside the line two in three do.) Lines of recurring templates are dropped.

Leaves are streamed in sorted order, one at a time, with only their templates in memory. Repeated lines
meet once, with counts combined before any shuffle; no group of documents is gathered, stands-for is a minimum.

Defined cases: null text stays null and has no lines; blank lines are never dropped; a document of nothing but one repeated line has no other lines,
so all such documents are one text; an empty table gives an empty result; rows with equal id and text count as one document and lose the same
lines; other columns pass through unchanged (those named like the added ones are replaced).
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_pandas
from millrace.llm.common import Scratch, mark_words, marked, marks, row_keys, split_by_marks, table, whole_texts

MIN_DOCS, MIN_TOKENS, DEPTH, ALIKE = 5, 4, 3, 0.7
#: Least hashes that stand for a document, and texts with a template of which one at least must be different.
SKETCH, NOISE = 8, 50
#: Templates of a leaf beyond which those that can be alike enough are looked up; the templates stay the same.
CROWD = 64
#: Characters of text whose lines are hashed at once.
AT_ONCE = 1 << 20
FIELD = "<*>"
_DIGIT = re.compile(r"\d")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xA0B428DB36C2F9D7)]


def mask(tokens: list[str]) -> list[str]:
    """Tokens with digits as variable fields."""
    return [FIELD if _DIGIT.search(t) else t for t in tokens]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def parsed(text: str | None, min_tokens: int, depth: int) -> Iterator[tuple[int, list[str], int]]:
    """(line number, tokens, leaf) of the lines that have tokens."""
    for number, line in enumerate((text or "").split("\n")):
        tokens = line.split()
        if len(tokens) >= min_tokens:
            yield number, tokens, _hash(f"{len(tokens)} {' '.join(mask(tokens[:depth]))}")
        elif tokens:
            yield number, tokens, _hash(f"= {' '.join(tokens)}")


def _leaves(docs: DataFrame, min_tokens: int, depth: int) -> DataFrame:
    """(leaf, n): how many lines each leaf has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((leaf for t in batch["text"] for _, _, leaf in parsed(t, min_tokens, depth)), np.uint64)
            leaf, n = np.unique(found, return_counts=True)
            yield pd.DataFrame({"leaf": leaf.view(np.int64), "n": n})

    return map_pandas(docs.select("text"), run, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))


def line_sketches(lines: list[list[str]]) -> np.ndarray:
    """The least hashes of each line's shingles of up to three words: (lines, SKETCH)."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    digest = xxhash.xxh3_64_intdigest
    codes = np.fromiter((digest(t.encode("utf-8", "replace")) for line in lines for t in line), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    found = codes * _ODD[0]
    for ahead in (1, 2):
        found[:-ahead] += np.where(left[:-ahead] > ahead, codes[ahead:] * _ODD[ahead], np.uint64(0))
    out = np.empty((len(lines), SKETCH), np.uint64)
    for j in range(SKETCH):
        spread = (found ^ (found >> np.uint64(29 + j))) * _ODD[j + 2]
        out[:, j] = np.minimum.reduceat(spread ^ (spread >> np.uint64(32)), starts)
    return out


def beside(sketches: np.ndarray, names: np.ndarray) -> np.ndarray:
    """What stands beside each line of a document: the least hashes of its lines of other names, 0 if there are none."""
    order = np.argsort(sketches, axis=0, kind="stable")
    out = np.empty_like(sketches)
    for j in range(sketches.shape[1]):
        best = order[0, j]
        others = order[names[order[:, j]] != names[best], j]
        out[:, j] = np.where(names == names[best], sketches[others[0], j] if len(others) else 0, sketches[best, j])
    return out


def _lines(docs: DataFrame, busy: np.ndarray, min_tokens: int, depth: int) -> DataFrame:
    """Lines of busy leaves: (__id, __h, number, leaf, line, masked, kinds); kinds: the sketch of what stands beside the line."""
    sent = docs.sparkSession.sparkContext.broadcast(busy)

    def shown(tokens: list[str]) -> str:
        return " ".join(mask(tokens) if len(tokens) >= min_tokens else tokens)

    def rows_of(held: list[tuple]) -> pd.DataFrame:
        """Rows of documents (id, hash, parsed lines, which are taken)."""
        out: dict[str, list] = {c: [] for c in ("__id", "__h", "number", "leaf", "line", "masked", "kinds")}
        if held:
            sketches = line_sketches([x[1] for _, _, lines, _ in held for x in lines])
            at = 0
            for i, h, lines, take in held:
                masked = [shown(x[1]) for x in lines]
                names = np.array([_hash(m) for m in masked], np.uint64)
                kinds = beside(sketches[at : at + len(lines)], names).view(np.int64)
                at += len(lines)
                for n in np.flatnonzero(take).tolist():
                    for c, v in zip(out, (i, h, lines[n][0], lines[n][2], names[n], masked[n], kinds[n].tolist()), strict=True):
                        out[c].append(v)
        frame = pd.DataFrame(out, dtype=None if held else object)
        for c in ("leaf", "line"):
            frame[c] = np.array(out[c], np.uint64).view(np.int64)
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for i, h, text in zip(batch["__id"].tolist(), batch["__h"].tolist(), batch["text"], strict=True):
                lines = list(parsed(text, min_tokens, depth))
                if lines and (take := marked(sent.value, np.array([x[2] for x in lines], np.uint64))).any():
                    held.append((i, h, lines, take))
                    size += len(text)
                if size > AT_ONCE:
                    yield rows_of(held)
                    held, size = [], 0
        yield rows_of(held)

    schema = "__id long, __h long, number int, leaf long, line long, masked string, kinds array<long>"
    return map_pandas(docs.select("__id", "__h", "text"), run, schema)


class Leaf:
    """Templates of one leaf; fields match no token by themselves."""

    def __init__(self, alike: float, depth: int = DEPTH, crowd: int = CROWD) -> None:
        self.alike, self.depth, self.crowd = alike, depth, crowd
        self.shapes, self.used, self.lines = np.zeros((4, 0), np.int64), 0, []
        #: Templates that have, or had, a token at a place; empty up to ``crowd`` templates.
        self.having: dict[int, int | array] = {}

    def take(self, masked: str) -> int:
        """The template of a line, which is widened by it or made from it."""
        codes = np.array([0 if t == FIELD else xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) >> 1 | 1 for t in masked.split(" ")], np.int64)
        if self.used:
            near = self._candidates(codes)
            same = (self.shapes[: self.used] if near is None else self.shapes[near]) == codes
            score = same.sum(axis=1)
            best = int(np.argmax(score)) if len(score) else -1
            if best >= 0 and score[best] >= self.alike * len(codes):
                at = best if near is None else int(near[best])
                self._widen(at, ~same[best])
                return at
        return self._add(codes, masked)

    def _candidates(self, codes: np.ndarray) -> np.ndarray | None:
        """Templates in order that hold all which are alike enough to a line; None for all of them.

        All lines of a leaf agree in their leading tokens. Of the others, ``need`` at least must agree, so that a template which is alike enough
        has two of any ``len - need + 2`` of them (one, if these are more than there are): the rarest are looked up.
        """
        need = math.ceil(self.alike * len(codes) - 1e-9) - self.depth
        if self.used <= self.crowd or need <= 0:
            return None
        if not self.having:
            for at in range(self.used):
                self._index(at, range(self.depth, len(codes)))
        found = [self.having.get(k, ()) for k in self._keys(codes, range(self.depth, len(codes)))]
        found = sorted(([x] if isinstance(x, int) else x for x in found), key=len)[: len(codes) - self.depth - need + 2]
        least = len(found) - (len(codes) - self.depth - need)
        values, counts = np.unique(np.concatenate([np.array(x, np.int64) for x in found]), return_counts=True)
        return values[counts >= least]

    def _keys(self, codes: np.ndarray, places: Iterable[int]) -> list[int]:
        """Tokens with their places."""
        return [hash((p, int(codes[p]))) for p in places]

    def _index(self, at: int, places: Iterable[int]) -> None:
        for k in self._keys(self.shapes[at], places):
            before = self.having.get(k)
            if before is None:
                self.having[k] = at
            elif isinstance(before, int):
                self.having[k] = array("q", (before, at))
            else:
                before.append(at)

    def _widen(self, at: int, differ: np.ndarray) -> None:
        """Makes places of a template fields."""
        new = np.flatnonzero(differ & (self.shapes[at] != 0))
        self.shapes[at, new] = 0
        if self.having:
            self._index(at, new.tolist())

    def _add(self, codes: np.ndarray, masked: str) -> int:
        if self.used == len(self.shapes) or not self.used:
            grown = np.zeros((max(4, 2 * self.used), len(codes)), np.int64)
            if self.used:
                grown[: self.used] = self.shapes[: self.used]
            self.shapes = grown
        self.shapes[self.used] = codes
        self.lines.append(masked)
        self.used += 1
        if self.having:
            self._index(self.used - 1, range(self.depth, len(codes)))
        return self.used - 1

    def shown(self, template: int) -> str:
        """A template with its fields."""
        return " ".join(w if c else FIELD for w, c in zip(self.lines[template].split(" "), self.shapes[template], strict=True))


def _templates(distinct: DataFrame, depth: int, alike: float, crowd: int) -> DataFrame:
    """(leaf, line, template) for distinct (leaf, line, masked): numbers of templates within the leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf = None, Leaf(alike, depth, crowd)
        for batch in batches:
            found = []
            for key, masked in zip(batch["leaf"].tolist(), batch["masked"], strict=True):
                if key != at:
                    at, leaf = key, Leaf(alike, depth, crowd)
                found.append(leaf.take(masked))
            yield pd.DataFrame({"leaf": batch["leaf"], "line": batch["line"], "template": np.array(found, np.int32)})

    return map_pandas(distinct.repartition("leaf").sortWithinPartitions("leaf", "line"), run, "leaf long, line long, template int")


def recurring(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, alike: float = ALIKE) -> DataFrame:
    """(__id, __h, number): the lines of recurring templates. docs: with row_keys."""
    busy = marks(_leaves(docs, min_tokens, depth).where(F.col("n") >= min_docs), "leaf")
    lines = scratch.save(_lines(docs, busy, min_tokens, depth), "lines")
    distinct = lines.groupBy("leaf", "line").agg(F.min("masked").alias("masked"))
    templates = scratch.save(_templates(distinct, depth, alike, CROWD), "templates")
    placed = lines.select("__id", "__h", "number", "leaf", "line", "kinds").join(templates.hint("merge"), ["leaf", "line"])
    placed = scratch.save(placed.select("__id", "__h", "number", F.xxhash64("leaf", "template").alias("t"), "kinds"), "placed")
    # The first document with a hash stands for all; who stands for itself in half of them is a text of its own.
    each = placed.select("t", F.xxhash64("__id", "__h").alias("d"), F.posexplode("kinds").alias("j", "kind"))
    first = each.groupBy("t", "j", "kind").agg(F.min("d").alias("d"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("j"))
    own = first.groupBy("t", "d").agg(F.bit_or(bit).alias("bits")).where(F.bit_count("bits") * 2 >= SKETCH)
    texts = placed.select("t", "__h").distinct().groupBy("t").agg(F.count("*").alias("texts"))
    counts = own.groupBy("t").agg(F.count("*").alias("own")).where(F.col("own") >= min_docs)
    often = scratch.save(counts.join(texts, "t").where(F.col("own") * NOISE >= F.col("texts")).select("t"), "often")
    return placed.select("__id", "__h", "number", "t").join(often.hint("merge"), "t", "left_semi").select("__id", "__h", "number")


def drop_recurring(docs: DataFrame, scratch: Scratch, **limits) -> DataFrame:
    """The documents without lines of recurring templates, with ``n_lines`` and ``n_dropped``."""
    keyed = row_keys(docs.drop("n_lines", "n_dropped"))
    hit = recurring(keyed, scratch, **limits).groupBy("__id", "__h").agg(F.collect_set("number").alias("__numbers"))
    hit = scratch.save(hit, "hit")
    touched, rest = split_by_marks(keyed, mark_words(hit, "__h"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("__numbers"), s["i"]))
    cut = touched.join(hit.hint("merge"), ["__id", "__h"], "left").withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
    cut = cut.withColumn("n_dropped", F.coalesce(F.size("__numbers"), F.lit(0)))
    cut = cut.withColumn("text", F.when(F.col("__numbers").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")))
    rest = rest.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))).withColumn("n_dropped", F.lit(0))
    cut = cut.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    return cut.drop("__numbers", "__id", "__h").unionByName(rest.drop("__id", "__h"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without recurring lines."""
    docs = whole_texts(table(spark, sf_dir, "documents"))
    return drop_recurring(docs, Scratch(spark, "templates")).select("doc_id", "text", "n_lines", "n_dropped")
