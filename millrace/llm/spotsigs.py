"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text's words are lower-cased and freed of punctuation. Each common word (anchor) starts a signature: itself and the next ``CHAIN``
content words, common words left out. The fingerprint is the sorted set of the signatures'
32-bit hashes in hex, eight digits each; likeness is the Jaccard measure of two sets. Near-duplicates are documents of a likeness of 0.8 or
more: sets are dealt into partitions by their length, so that only those of alike lengths are compared, and within one they meet under one of their rarer signatures
(see ``set_join``, which prunes by lengths and bounds of the overlap, and verifies whole sets).

Defined cases: null counts as empty; texts of fewer than ``LEAST`` signatures add the chain that starts at every word,
and texts too short for any chain are one signature of all their words, so a fingerprint is never blank and equal texts have equal
ones. Ids are ordered as numbers, null first; of equal ids the text of the smaller hash comes first; the last document's next is the
first, and a single document's is itself. Rows with equal id and text share their class. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_pandas
from millrace.llm.common import Scratch, table, whole_texts
from millrace.llm.set_join import Sets, similar

CHAIN, LEAST = 3, 4
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that for it was on with as be by at this from are or an have not but they you he she we his her their which "
        "le la les de des du et en un une est que qui dans pour sur avec pas au aux ce il elle ne se par plus "
        "der die das und ist in den von zu mit ein eine im nicht für auf dem des sich es auch als an bei er sie "
        "el los las un una y que es por con para del se no al lo como su más"
    ).split()
)
#: Rows between two split points of the order by id, and the most split points. Each is chosen among ``DRAWN`` drawn rows.
BETWEEN, MOST_SPLITS, DRAWN = 4096, 1 << 12, 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = bytes(ord(" ") if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 32 else b for b in range(256))


def signatures(text: str | None) -> np.ndarray:
    """The sorted set of a text's signature hashes."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()
    content, anchors, places = [], [], []
    for w in words:
        if w in ANCHORS:
            anchors.append(w)
            places.append(len(content))
        else:
            content.append(w)
    digest, most = xxhash.xxh32_intdigest, len(content) - CHAIN
    chains = [b" ".join(c) for c in zip(*(content[i:] for i in range(CHAIN)), strict=False)]
    found = {digest(a + b" " + chains[p]) for a, p in zip(anchors, places, strict=True) if p <= most}
    if len(found) < LEAST:
        found.update(digest(b" ".join(words[i : i + CHAIN])) for i in range(len(words) - CHAIN + 1))
        if not found:
            found.add(digest(b" ".join(words)))
    return np.sort(np.fromiter(found, np.uint32, len(found)))


def shown(marks: np.ndarray) -> str:
    """Signatures in hex, eight digits each."""
    return marks.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    """The signatures of a fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard measure of two sets of signatures."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@dataclass(frozen=True)
class Signatures(Sets):
    """A text's signatures, as bytes, as a set to join by, in partitions by length."""

    def name(self, text: bytes) -> int:
        return xxhash.xxh3_64_intdigest(text)

    def members(self, text: bytes) -> np.ndarray:
        return np.sort((np.frombuffer(text, np.uint32).astype(np.uint64) + np.uint64(1)) * _SPREAD)

    def dealt(self, taken: np.ndarray, size: int, similarity: float) -> np.ndarray:
        # In each partition the largest set is 1 / similarity times the least, so that partners stand in one or in neighbours.
        part = math.floor(math.log(size) / -math.log(similarity) + 1e-9)
        return np.concatenate([(taken ^ np.uint64(p)) * _SPREAD for p in (part, part + 1)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [shown(signatures(t)) for t in batch["text"]]})

    return map_pandas(whole_texts(docs), run, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, scratch: Scratch, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): class_id is the least id reachable over documents of a likeness of at least ``threshold``.

    Signatures are taken from the texts once and stored while sets are compared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [signatures(t).tobytes() for t in batch["text"]]})

    sets = scratch.save(map_pandas(whole_texts(docs), run, "doc_id long, text binary"), "sets")
    found = similar(sets, scratch, Signatures(), threshold).withColumnRenamed("component_id", "class_id")
    found = scratch.save(found, "near")
    scratch.drop("sets")
    return found


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the next one's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """(part, tail, ord, h, doc_id, text, class_id): rows dealt into parts of the order by id and hash of the text.

    Each part also gets, as its tail, the row that follows its last: the next part's first, or for the last part the very first.
    Split points are drawn rows of the table, so that parts are never empty. docs: (doc_id, text, class_id), of which rows without text and with a
    class only tell that of the document they precede.
    """
    least = -(1 << 63)
    keyed = docs.withColumn("ord", F.coalesce("doc_id", F.lit(least).cast("long"))).withColumn("key", F.struct("ord", "h"))
    real = keyed.where("told is null")
    stats = real.agg(F.count("*").alias("n"), F.min("key").alias("first")).first()
    parts = min(MOST_SPLITS, max(1, stats.n // BETWEEN))
    first = tuple(stats.first) if stats.first is not None else (least, 0)
    drawn = real.select("ord", "h", F.xxhash64("ord", "h").alias("lot")).distinct().orderBy("lot", "ord", "h").limit(DRAWN * parts) if parts > 1 else None
    cuts = sorted((r.ord, r.h) for r in drawn.collect())[DRAWN // 2 :: DRAWN] if drawn is not None else []
    cuts = [c for c in cuts if c > first]

    def listed(rows: list[tuple[int, int]]) -> F.Column:
        return F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), F.lit(h).cast("long").alias("h")) for o, h in rows))

    # Two steps of comparisons find a row's part: among every so many split points, then among those between.
    stride = max(1, int(len(cuts) ** 0.5))
    if cuts:
        keyed = keyed.withColumn("block", F.size(F.filter(listed(cuts[::stride]), lambda c: c <= F.col("key"))))
        inside = F.element_at(F.array(*(listed(cuts[i : i + stride]) for i in range(0, len(cuts), stride))), F.greatest("block", F.lit(1)))
        part = F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * stride + F.size(F.filter("inside", lambda c: c <= F.col("key"))))
        keyed = keyed.withColumn("inside", inside).withColumn("part", part.cast("int"))
        begins = (F.col("block") > 0) & F.exists("inside", lambda c: c == F.col("key"))
    else:
        keyed = keyed.withColumn("part", F.lit(0))
        begins = F.lit(False)
    own = F.struct(F.col("part"), F.lit(0).alias("tail"))
    before = F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("tail"))
    round_ = F.struct(F.lit(len(cuts)).alias("part"), F.lit(1).alias("tail"))
    opening = F.col("key") == F.struct(F.lit(first[0]).cast("long").alias("ord"), F.lit(first[1]).cast("long").alias("h"))
    copies = F.when(F.col("told").isNotNull(), F.array(own)).when(opening, F.array(own, round_)).when(begins, F.array(own, before)).otherwise(F.array(own))
    return keyed.select("doc_id", "text", "ord", "h", "told", "class_id", F.explode(copies).alias("x")).select("x.part", "x.tail", "ord", "h", "told", "doc_id", "text", "class_id")


def compare_edits(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, with the class of its near-duplicates."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        held = told = None  # held: (part, doc_id, text, signatures, class), waiting for what follows it
        for batch in batches:
            rows = []
            columns = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("told", "doc_id", "text", "class_id"))
            for part, tail, tells, doc_id, text, class_id in zip(batch["part"].tolist(), batch["tail"].tolist(), *columns, strict=True):
                if tells is not None:
                    told = class_id
                    continue
                if held is not None and held[0] != part:
                    held = None
                if tail and held is None:
                    continue  # the part's last document has its neighbour already
                text = "" if text is None else text
                own = held[3] if held is not None and held[2] == text else signatures(text)
                if held is not None:
                    _, before, was, marks, group = held
                    changed = edited(was, text)
                    other = marks if changed == was else signatures(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                    rows.append((before, len(was), digest, shown(marks), shown(other), likeness(marks, other), likeness(marks, own), group))
                held = None if tail else (part, doc_id, text, own, told)
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame.astype({"doc_id": "Int64", "class_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    texts = whole_texts(docs).withColumn("h", F.xxhash64("text"))
    # Hashes stand for documents while they are grouped: a group's name is that of its member of least id.
    groups = scratch.save(near_duplicates(texts.select(F.col("h").alias("doc_id"), "text"), scratch).distinct(), "groups")
    members = scratch.save(texts.select("doc_id", "h").distinct().join(groups.select(F.col("doc_id").alias("h"), F.col("class_id").alias("g")).hint("merge"), "h"), "members")
    least = scratch.save(members.groupBy("g").agg(F.min("doc_id").alias("class_id")), "classes")
    tells = members.join(least.hint("merge"), "g").select("doc_id", F.lit(None).cast("string").alias("text"), "h", F.lit(1).alias("told"), "class_id")
    rows = texts.select("doc_id", "text", "h", F.lit(None).cast("int").alias("told"), F.lit(None).cast("long").alias("class_id")).unionByName(tells)
    dealt = in_order(rows).repartition("part").sortWithinPartitions("part", "tail", "ord", "h", F.col("told").asc_nulls_last())
    return map_pandas(dealt.select("part", "tail", "told", "doc_id", "text", "class_id"), run, schema)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, how near they are, and the class of its near-duplicates."""
    return compare_edits(table(spark, sf_dir, "documents"), Scratch(spark, "spotsigs"))
