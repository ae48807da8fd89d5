"""Near-duplicates at a given similarity: an exact join of sets, such as word shingles.

Texts are similar if their sets have a Jaccard of ``similarity`` or more. Under any one order of all members, two such
texts share a member among the first n - ceil(similarity n) + 1 of each (n: members of the set), so those that share one of these meet, and no
pair is missed. The order puts members last that stand in many texts. The place of a member tells more: if it is the first that a pair shares, the overlap is at
most what follows it, so that it serves partners up to some size only; members that serve no one they meet are left out before anything is compared (letters
of one form that fall short of the similarity never meet). What meets is first held against an upper bound of the overlap (members
counted in ``BUCKETS`` buckets), and what passes is verified with the whole sets.

Links need to connect groups, not to name all pairs: crowds of more than ``SMALL`` texts first grow trees, and
after these are verified, texts of a crowd are compared with all that they are not connected to yet, each pair under the first crowded member it shares.
Where SimHash goes before (``firsts``), its links are verified in the same way, and the texts they connect are not compared again.

Defined cases: null counts as empty. Texts without words are alike; texts of fewer words than a shingle are one shingle. Texts of equal sets' names
(for shingles: of equal words) are one node, so copies make no pairs. Rows with equal id and text are one document; a null id is no component's name if there is another; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow, map_pandas
from millrace.llm import simhash
from millrace.llm.common import Scratch, marked, marks, whole_texts
from millrace.llm.components import components

#: Texts with a shingle from which on it is ordered last; only the work depends on it.
COMMON = 32
#: Of so many texts one tells which members are common.
SAMPLED = 8
#: Members of a meeting up to which all are compared at once.
SMALL = 64
#: Crowded members of a text that are told to others, so that a pair which shares several is given once; pairs of texts with more may be given again.
LISTED = 32
BUCKETS = 128
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Sets:
    """What a text's set is."""

    def name(self, text: str | None) -> int:
        """A 64-bit name that equal sets share."""
        raise NotImplementedError

    def members(self, text: str | None) -> np.ndarray:
        """The set as ordered 64-bit hashes."""
        raise NotImplementedError

    def dealt(self, taken: np.ndarray, size: int, similarity: float) -> np.ndarray:
        """The keys under which a set of ``size`` members meets others, from its first members."""
        return taken


@dataclass(frozen=True)
class Shingles(Sets):
    """Word shingles; words are cut at ASCII white space and compared lower-cased (A to Z)."""

    words: int = 5

    def name(self, text: str | None) -> int:
        return xxhash.xxh3_64_intdigest(b" ".join(_tokens(text)))

    def members(self, text: str | None) -> np.ndarray:
        return shingles(_tokens(text), self.words)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(tokens: list[bytes], words: int = 5) -> np.ndarray:
    """The text's set of shingles as ordered 64-bit hashes; a zero for no words."""
    if not tokens:
        return np.zeros(1, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    found = np.zeros(n, np.uint64)
    for i in range(min(words, len(tokens))):
        found += codes[i : i + n] * np.uint64(pow(_ODD, i + 1, 1 << 64))
    return np.unique((found ^ (found >> np.uint64(32))) * _MIX)


def leading(n: int, similarity: float) -> int:
    """How many first shingles of n hold one of every similar text."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def reach(n: int, at: np.ndarray, similarity: float) -> np.ndarray:
    """The greatest partner that members at some places of a set of n can be the first shared ones with: n - at must suffice for the overlap."""
    return np.floor((n - at) * (1 + similarity) / similarity - n + 1e-6).astype(np.int32)


def packed(found: np.ndarray) -> np.ndarray:
    """A set in five bytes a member: the leading 40 bits of its hashes, the highest eight apart (in order, they shrink to nothing)."""
    return np.concatenate(((found >> np.uint64(56)).astype(np.uint8), np.frombuffer((found >> np.uint64(24)).astype(np.uint32).tobytes(), np.uint8)))


def unpacked(raw: bytes) -> np.ndarray:
    """The members of a packed set, in order."""
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint8, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, np.uint32, n, n)


def sketch(found: np.ndarray) -> np.ndarray:
    """Shingles in each bucket; full buckets all over where one of them overflows, so that bounds stay upper bounds."""
    counts = np.bincount((found % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return np.full(BUCKETS, 255, np.uint8) if counts.max() > 255 else counts.astype(np.uint8)


def _per_text(docs: DataFrame, function, schema: str) -> DataFrame:
    """Rows that ``function(text)`` gives for texts, in columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                rows = [r for t in batch["text"].iloc[i : i + 2000] if (r := function(t)) is not None]
                if rows:
                    yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return map_pandas(docs.select("text"), run, schema)


def _named(docs: DataFrame, sets: Sets) -> DataFrame:
    """(doc_id, node): the name of each document's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": np.fromiter((sets.name(t) for t in batch["text"]), np.uint64, len(batch)).view(np.int64)})

    return map_pandas(whole_texts(docs), run, "doc_id long, node long")


def _common(docs: DataFrame, sets: Sets, similarity: float) -> np.ndarray:
    """Marks of members that stand in many texts, told by the whole sets of one text in ``SAMPLED``; only the order of members depends on them."""

    def some(text: str | None) -> tuple[np.ndarray] | None:
        return (sets.members(text).view(np.int64),) if sets.name(text) % SAMPLED == 0 else None

    counts = _per_text(docs, some, "key long").repartition("key").groupBy("key").agg(F.count("*").alias("n"))
    return marks(counts.where(F.col("n") >= COMMON // SAMPLED), "key")


def _keys(docs: DataFrame, common: np.ndarray, sets: Sets, similarity: float) -> DataFrame:
    """(key, node, size): the first members of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def first(text: str | None) -> tuple[np.ndarray, ...]:
        node, found = sets.name(text), sets.members(text)
        late = marked(sent.value, found)
        taken = np.concatenate((found[~late], found[late]))[: leading(len(found), similarity)]
        keys = sets.dealt(taken, len(found), similarity)
        most = np.tile(reach(len(found), np.arange(len(taken)), similarity), len(keys) // max(1, len(taken)))
        return keys.view(np.int64), np.full(len(keys), node, np.uint64).view(np.int64), np.full(len(keys), len(found), np.int32), most

    return _per_text(docs, first, "key long, node long, size int, most int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.ChunkedArray]]:
    """Tables of whole keys, from rows sorted by key (the first column)."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if held and keys[0] != held[-1].column(0)[-1].as_py():
            if not last:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, size, most, n) of keys with n > 1 nodes, each node once. Rows come sorted by key and node.

    Nodes that find no partner under a key that both could share first are left out of it.
    """
    for table in _groups(batches):
        key, node, size, most = (c.to_numpy() for c in table.columns)
        kept = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        while True:
            key, node, size, most = key[kept], node[kept], size[kept], most[kept]
            if not key.size:
                break
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(starts, key.size))
            least, reached, count = (np.repeat(x, n) for x in (np.minimum.reduceat(size, starts), np.maximum.reduceat(most, starts), n))
            kept = (least <= most) & (reached >= size) & (count > 1)
            if kept.all():
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(size, pa.int32()), pa.array(most, pa.int32()), pa.array(count, pa.int64())], ["key", "node", "size", "most", "n"])
                break


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of up to ``LISTED`` numbers as rows, filled up with the greatest number."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), LISTED), np.iinfo(np.int64).max)
    out[np.arange(LISTED) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _meet(similarity: float, trees: bool):
    """Gives pairs of different roots that may be similar, from rows (key, node, size, most, root, sketch) sorted by key.

    trees: crowds give only pairs that connect them. Otherwise all rows are of crowds and end with their text's first crowded keys; a pair is then given under
    the least crowded key that it shares, which need not be its first member, so that sizes alone bound it.
    """
    part = similarity / (1 + similarity)

    def settle(table: pa.Table) -> pa.RecordBatch:
        key, node, size, most, root = (c.to_numpy() for c in table.columns[:5])
        named = None if trees else _matrix(table.column(6).combine_chunks())
        prints = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(-1, BUCKETS)

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Which of pairs x, y may be similar."""
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            may = (low >= similarity * high - 1e-9) & (root[x] != root[y])
            if trees:
                may &= (size[y] <= most[x]) & (size[x] <= most[y])
            at = np.flatnonzero(may)
            for i in range(0, len(at), 1 << 16):
                a, b = x[at[i : i + (1 << 16)]], y[at[i : i + (1 << 16)]]
                bound = np.minimum(prints[a], prints[b]).sum(axis=1, dtype=np.int64)
                may[at[i : i + (1 << 16)]] = bound >= np.minimum(part * (size[a] + size[b]) - 1e-6, 255 * BUCKETS)
            return may

        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        stop = np.repeat(starts + sizes, sizes)
        at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        lag = 1
        while len(at := at[at + lag < stop[at]]):
            hit = at[near(at, at + lag)]
            left.append(node[hit])
            right.append(node[hit + lag])
            lag += 1
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            rest, grown = np.arange(s, s + n), []
            if (root[s : s + n] == root[s]).all():
                continue
            if not trees:
                # One of two that are not connected stands outside the crowd's largest group.
                values, times = np.unique(root[s : s + n], return_counts=True)
                inside = root[s : s + n] == values[np.argmax(times)]
                rest, outside = rest[inside], rest[~inside]
                for k, one in enumerate(outside.tolist()):
                    others = np.concatenate((rest, outside[k + 1 :]))
                    hit = others[near(np.full(len(others), one), others)]
                    before = named[one][named[one] < key[one]]
                    hit = hit[~np.isin(named[hit], before).any(axis=1)]
                    left.append(np.full(len(hit), node[one]))
                    right.append(node[hit])
                continue
            while len(rest):
                one = grown.pop() if grown else rest[0]
                rest = rest[rest != one]
                hit = near(np.full(len(rest), one), rest)
                left.append(np.full(int(hit.sum()), node[one]))
                right.append(node[rest[hit]])
                grown += rest[hit].tolist()
                rest = rest[~hit]
        ends = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
        a, b = np.minimum(*ends), np.maximum(*ends)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        return pa.RecordBatch.from_arrays([pa.array(x[fresh], pa.int64()) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            yield settle(table)

    return run


def _compared(similarity: float):
    """The similar of pairs (a, b), from rows (a, b, found) sorted by a and b: first a's own set, with b null, then those of each b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = unpacked(raw)
                if b is None:
                    own = found
                    continue
                both = np.sort(np.concatenate((own, found)))
                shared = int((both[1:] == both[:-1]).sum())
                if shared >= similarity * (len(both) - shared) - 1e-9:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _of_nodes(docs: DataFrame, sets: Sets, nodes: DataFrame, shown, column: str) -> DataFrame:
    """(node, column): ``shown(set)`` as bytes for each node that ``nodes`` marks."""
    sent = docs.sparkSession.sparkContext.broadcast(marks(nodes, "node"))

    def one(text: str | None) -> tuple | None:
        name = np.array([sets.name(text)], np.uint64)
        return (name.view(np.int64), np.array([shown(sets.members(text)).tobytes()], object)) if marked(sent.value, name)[0] else None

    return _per_text(docs, one, f"node long, {column} binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, sets: Sets, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    pairs = scratch.save(pairs.distinct(), f"{name}-pairs")
    whole = scratch.save(_of_nodes(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), packed, "found"), f"{name}-sets")
    own = whole.join(pairs.select(F.col("a").alias("node")).distinct().hint("merge"), "node", "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "found")
    others = pairs.join(whole.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "b", "found")
    rows = own.unionByName(others).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    found = scratch.save(map_arrow(rows, _compared(similarity), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-pairs")
    scratch.drop(f"{name}-sets")
    return found


def links(docs: DataFrame, scratch: Scratch, sets: Sets, similarity: float = 0.8, likely: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of similar nodes that connect all nodes that similar pairs connect.

    likely: pairs (a, b) of nodes found in another way. They are verified first, and what they connect does not meet again.
    """
    known = None if likely is None else _verified(likely, docs, sets, similarity, scratch, "likely")
    keys = _keys(docs, _common(docs, sets, similarity), sets, similarity)
    shared = scratch.save(map_arrow(keys.repartition("key").sortWithinPartitions("key", "node"), _shared, "key long, node long, size int, most int, n long"), "shared")
    sketches = scratch.save(_of_nodes(docs, sets, shared, sketch, "sketch"), "sketches")

    crowds = shared.where(F.col("n") > SMALL)

    def met(rows: DataFrame, trees: bool) -> DataFrame:
        rows = rows.join(sketches.hint("merge"), "node")
        columns = ["key", "node", "size", "most", "root", "sketch"]
        if not trees:
            listed = crowds.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LISTED).alias("named"))
            rows, columns = rows.join(listed.hint("merge"), "node"), [*columns, "named"]
        rows = rows.select(*columns)
        return map_arrow(rows.repartition("key").sortWithinPartitions("key"), _meet(similarity, trees), "a long, b long")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    first = shared.withColumn("root", F.col("node")) if known is None else rooted(shared, components(known, scratch))
    found = _verified(met(first, True), docs, sets, similarity, scratch, "first")
    if known is not None:
        found = known.unionByName(found)
    if not crowds.isEmpty():
        found = found.unionByName(_verified(met(rooted(crowds, components(found, scratch)), False), docs, sets, similarity, scratch, "rest"))
    scratch.drop("shared")
    scratch.drop("sketches")
    return found


def similar(docs: DataFrame, scratch: Scratch, sets: Sets = Shingles(), similarity: float = 0.8, prints: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): component_id is the least id reachable over links of near-duplicates.

    prints: (doc_id, bits), SimHash fingerprints, which texts of equal sets' names must share. Pairs that they link are verified first; what they miss, this join finds.
    """
    named = scratch.save(_named(docs, sets), "nodes")
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("first"))
    likely = None if prints is None else simhash.spanning(nodes.join(prints.withColumnRenamed("doc_id", "first").distinct(), "first").select("node", "bits"), scratch)
    roots = components(links(docs, scratch, sets, similarity, likely), scratch)
    rooted = scratch.save(nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    found = scratch.save(rooted.join(least.hint("merge"), "root").select("node", "component_id"), "named")
    return named.join(found.hint("merge"), "node").select("doc_id", "component_id")


def firsts(docs: DataFrame, scratch: Scratch, sets: Sets = Shingles(), similarity: float = 0.8) -> DataFrame:
    """(__id, __h) of one row of each group of similar texts: the least id, null last, then the least hash. docs: with row_keys.

    SimHash links what it can, which is then verified; the join of sets finds the rest.
    """
    alone = docs.select(F.col("__h").alias("doc_id"), "text")
    prints = scratch.save(simhash.fingerprints(alone), "prints")
    groups = scratch.save(similar(alone, scratch, sets, similarity, prints).distinct().withColumnsRenamed({"doc_id": "__h", "component_id": "__group"}), "groups")
    rows = docs.select("__id", "__h", F.col("doc_id").isNull().alias("unnamed")).join(groups.hint("merge"), "__h")
    return rows.groupBy("__group").agg(F.min(F.struct("unnamed", "__id", "__h")).alias("first")).select("first.__id", "first.__h")
