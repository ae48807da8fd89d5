"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

A fingerprint holds the majority bits of the XXH64 (seed 42) of a text's word shingles. Fingerprints of at
most ``distance`` differing bits leave ``blocks - distance`` of ``blocks`` bit blocks alike, so that
every such pair meets under one choice of that many blocks. Within a meeting only a spanning forest of
the verified links is kept. Meetings with more than ``CROWD`` different fingerprints are not compared
pair by pair: their members meet again at the values halfway between them (at most distance / 2 bits from
each), where links are exact and each value has one star.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other; equal
fingerprints are one node, so copies make no pairs; rows with a null id keep a null id and a component of
their own fingerprint's ids; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow, map_pandas
from millrace.llm.common import Scratch, table, whole_texts
from millrace.llm.components import components

SEED, BITS = 42, 64
#: Different fingerprints that are compared pair by pair in one meeting.
CROWD = 4096
#: Shingles whose bits are unpacked at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 majority bits of the text's shingles; zero for no words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, n, AT_ONCE):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bits": found.view(np.int64)})

    return map_pandas(whole_texts(docs), run, "doc_id long, bits long")


def block_keys(bits: Column, distance: int, blocks: int) -> list[Column]:
    """One key for each choice of blocks - distance blocks: which choice, and their bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(parts[i])
        keys.append(key)
    return keys


def _forest(members: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span what is linked among different fingerprints."""
    left, right, rest = [], [], members
    frontier: list[int] = []
    while len(rest) or frontier:
        if frontier:
            at = frontier.pop()
        else:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ at) <= distance
        if near.any():
            hit = rest[near]
            left.append(np.full(len(hit), at))
            right.append(hit)
            frontier += list(hit)
            rest = rest[~near]
        if not len(rest):
            break
    return left, right


def _meetings(distance: int):
    """Streams rows (key, bits) sorted by both; gives forest links, and members of crowds with a null end."""

    def links_of(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        near = np.bitwise_count(bits[two] ^ bits[two + 1]) <= distance
        left, right = [bits[two][near]], [bits[two + 1][near]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            a, b = _forest(bits[start : start + size], distance)
            left += a
            right += b
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        keys, bits, crowd = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def out(left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
            ends = pa.nulls(len(left), pa.int64()) if right is None else pa.array(right.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), ends], schema=schema)

        for batch in batches:
            new_keys, new_bits = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if crowd is not None:  # the last meeting was a crowd: what it still gets goes straight on
                other = np.flatnonzero(new_keys != crowd)
                more = int(other[0]) if len(other) else len(new_keys)
                if more:
                    yield out(new_bits[:more], None)
                    new_keys, new_bits = new_keys[more:], new_bits[more:]
                if not len(new_keys):
                    continue
                crowd = None
            keys, bits = np.concatenate((keys, new_keys)), np.concatenate((bits, new_bits))
            if not len(keys):
                continue
            last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
            whole, open_keys, open_bits = slice(0, last), keys[last:], bits[last:]
            yield from settle(keys[whole], bits[whole], out)
            if len(open_keys) > CROWD:
                crowd = open_keys[0]
                yield out(open_bits, None)
                open_keys, open_bits = open_keys[:0], open_bits[:0]
            keys, bits = open_keys, open_bits
        yield from settle(keys, bits, out)

    def settle(keys: np.ndarray, bits: np.ndarray, out) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        crowded = np.repeat(sizes > CROWD, sizes)
        if crowded.any():
            yield out(bits[crowded], None)
            keys, bits = keys[~crowded], bits[~crowded]
        if len(keys):
            yield out(*links_of(keys, bits))

    return run


def _halfway(crowd: DataFrame, distance: int) -> DataFrame:
    """Links of members of crowds: stars at all values up to half the distance from each."""
    bit = [1 << i for i in range(BITS)]
    masks = [sum(c) for n in range(distance // 2 + distance % 2 + 1) for c in combinations(bit, n)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    spread = crowd.select("bits", F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: m.bitwiseXOR(F.col("bits")))).alias("mid"))
    stars = spread.groupBy("mid").agg(F.min("bits").alias("least"), F.max("bits").alias("most")).where("least < most").select("mid", "least")
    met = spread.join(stars, "mid").where(F.col("bits") != F.col("least"))
    return met.select(F.col("bits").alias("a"), F.col("least").alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * (distance // 2 + distance % 2)).distinct()


def links(prints: DataFrame, scratch: Scratch, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(a, b): fingerprints of at most ``distance`` differing bits, which connect all that such pairs connect; hubs are at b.

    prints: (bits), repeats allowed. ``distance`` must be even, for the halfway values of crowds.
    """
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even, and less than blocks")
    keys = F.explode(F.array(*block_keys(F.col("bits"), distance, blocks)))
    spread = prints.select("bits").distinct().select(keys.alias("key"), "bits")
    met = map_arrow(spread.repartition("key").sortWithinPartitions("key", "bits"), _meetings(distance), "a long, b long")
    met = scratch.save(met, "met")
    crowd = scratch.save(met.where("b is null").select(F.col("a").alias("bits")).distinct(), "crowd")
    found = met.where("b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return found if crowd.isEmpty() else found.unionByName(_halfway(crowd, distance))


def linked(prints: DataFrame, scratch: Scratch, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(bits, root): component of each fingerprint that has links and isn't its least one."""
    return components(links(prints, scratch, distance, blocks), scratch).select(F.col("node").alias("bits"), "root")


def spanning(prints: DataFrame, scratch: Scratch, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(a, b): pairs of nodes whose fingerprints are linked, which connect all nodes of linked fingerprints. prints: (node, bits)."""
    first = scratch.save(prints.groupBy("bits").agg(F.min("node").alias("first")), "first-of-bits")
    alike = prints.join(first.hint("merge"), "bits").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = links(first, scratch, distance, blocks).distinct()
    for end in ("a", "b"):
        found = found.join(first.select(F.col("bits").alias(end), F.col("first").alias(f"{end}_first")).hint("merge"), end)
    return scratch.save(alike.unionByName(found.select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))), "spanning")


def group(docs: DataFrame, scratch: Scratch, words: int = 4, distance: int = 4, blocks: int = 7) -> DataFrame:
    """(doc_id, bits, component_id): component_id is the least id reachable over links."""
    prints = scratch.save(fingerprints(docs, words), "prints")
    roots = linked(prints, scratch, distance, blocks)
    first = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    rooted = scratch.save(first.join(roots, "bits", "left").select("bits", "first", F.coalesce("root", "bits").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = scratch.save(rooted.join(least.hint("merge"), "root").select("bits", "component_id"), "named")
    return prints.join(named.hint("merge"), "bits").select("doc_id", "bits", "component_id")


def shown(bits: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = group(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", shown(F.col("bits")).alias("fingerprint"), "component_id")
