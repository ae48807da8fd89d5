"""Ranked lexical search by pipelined term partitioning.

The terms of the queries are owned by stages, rare terms first. Each stage's postings lie in its own folder, cut into shards of documents, so that a frequent
term is spread over all of them. Bundles of queries carry sparse accumulators (query, document, score so far) from stage to stage: a stage cogroups them by
bundle and shard with the postings it owns and adds whole-number contributions; the last one selects each shard's best, and a window the best of all.

Between stages the accumulators shrink without loss: with t a lower bound of a query's ``top``-th best score so far, a document whose score and what the
remaining stages can add at most stay below t is dropped, and one that was not met yet is not taken in once those stages alone can't reach t.

Queries are taken in blocks of ``BLOCK_BYTES`` of text, each a pass over the documents; what tasks and driver hold of queries is one block's terms.
Documents are cut into terms once a block, in Python workers, whole; only how often a document holds the block's terms is kept.

Defined cases: null and empty texts have no terms, and queries without terms, or none that a document holds, give no rows; documents or queries with equal
or null ids are each ranked for themselves (null first among equal scores); no documents or no queries give an empty result; terms that every document
holds may weigh 0 and then add nothing. A query longer than a block is a block of its own. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.workers import importable, map_arrow
from millrace.llm.common import Scratch, table

#: Rows for a query, bytes of query text of a block, queries of a bundle, documents of a shard.
TOP, BLOCK_BYTES, BUNDLE, SHARD = 50, 4 << 20, 256, 8192
#: A stage owns the terms that at most one document in so many holds (and no earlier stage owns).
OWNERS = (1000, 100, 10, 1)
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20
#: What a contribution's factor is below, whatever tf and length are.
MOST_FACTOR = 1_000_000
#: Letters and digits of ASCII stay (A-Z in lower case), all other ASCII bytes separate terms.
_ASCII = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
_CELLS = "bundle int, shard int, cells array<int>, scores array<long>, best_query array<int>, best_floor array<long>, best_count array<int>"
_FOUND = "query int, score long, shard int, place int, doc_id long"


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of one piece each."""
    if len(raw) <= PIECE:
        yield raw.translate(_ASCII).split()
        return
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _ASCII[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_ASCII).split()
        at = end


@dataclass
class Block:
    """Queries that are answered together: their ids, and for each its terms as numbers."""

    ids: list[int | None]
    terms: list[list[int]]
    numbers: dict[bytes, int]


def blocks(queries: DataFrame, id_column: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Queries (id, text) by id, as many at once as ``limit`` bytes of text hold."""
    block, size = Block([], [], {}), 0
    rows = queries.where(F.col("text").isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    for r in rows.orderBy("id", "text").toLocalIterator():
        if size and size + len(r.text) > limit:
            yield block
            block, size = Block([], [], {}), 0
        found = {t for piece in terms(bytes(r.text)) for t in piece}
        if found:
            block.ids.append(r.id)
            block.terms.append([block.numbers.setdefault(t, len(block.numbers)) for t in sorted(found)])
            size += len(r.text)
    if block.ids:
        yield block


def vectors(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has a term at all: n counts all its terms, the lists only the block's."""
    numbers = block.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, held, tfs = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, met = 0, Counter()
                for piece in terms(memoryview(raw.as_buffer()).tobytes()):
                    n += len(piece)
                    met.update(filter(numbers.__contains__, piece))
                if n:
                    ids.append(doc_id)
                    ns.append(n)
                    held.append([numbers[t] for t in met])
                    tfs.append(list(met.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(texts, run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(df: int, n: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def factors(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m), as int32: it is below a million as m is 50 at least."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf // (1000 * tf + 20 * m)).astype(np.int32)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and lengths."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)


def write_postings(found: DataFrame, scratch: Scratch, owner: np.ndarray, n: int, total: int, shards: int) -> DataFrame:
    """Postings by (owner, shard): term numbers, where their places end, places in the shard and factors.

    Shards are ranges of ids, in whose order places count, so that ties go by shard and place. Every owner has a row in every shard; the last one's
    also lists the ids of the shard's documents.
    """
    last = int(owner.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, numbers, scaled, shard, count = [], [], [], [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, lengths = _flat(batch.column(2))
                tfs, _ = _flat(batch.column(3))
                m = np.array([50 + 50 * x * n // total for x in batch.column(1).to_pylist()], np.int64)
                at = np.repeat(np.arange(batch.num_rows), lengths)
                places.append((at + count).astype(np.int32))
                numbers.append(held)
                scaled.append(factors(tfs, m[at]))
                ids.append(batch.column(0))
                shard, count = batch.column(4)[0].as_py(), count + batch.num_rows
        if not count:
            return
        place, number, factor = np.concatenate(places), np.concatenate(numbers), np.concatenate(scaled)
        order = np.argsort(number, kind="stable")
        place, number, factor = place[order], number[order], factor[order]
        for s in range(last + 1):
            mine = owner[number] == s
            own, starts = np.unique(number[mine], return_index=True)
            ends = np.append(starts[1:], mine.sum())[: own.size].astype(np.int32)
            listed = pa.array([pa.concat_arrays(ids).to_pylist() if s == last else []], pa.list_(pa.int64()))
            columns = [pa.array([x], pa.list_(pa.int32())) for x in (own.astype(np.int32), ends, place[mine], factor[mine])]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([count], pa.int32()), *columns, listed, pa.array([s], pa.int32())], ["shard", "size", "terms", "ends", "places", "factors", "ids", "owner"])

    dealt = found.where(F.size("terms") > 0).repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = map_arrow(dealt.select("doc_id", "n", "terms", "tfs", F.spark_partition_id().alias("shard")), run, "shard int, size int, terms array<int>, ends array<int>, places array<int>, factors array<int>, ids array<long>, owner int")
    return scratch.save(rows, "postings", ["owner"])


def _of_bundles(postings: DataFrame, used: list[np.ndarray]) -> DataFrame:
    """A stage's postings for each bundle, with the bundle's own terms only. used: the terms of each bundle."""
    columns = ["bundle", "shard", "size", "terms", "ends", "places", "factors", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own, ends = row.column(2)[0].values.to_numpy(), row.column(3)[0].values.to_numpy()
                place, factor = row.column(4)[0].values.to_numpy(), row.column(5)[0].values.to_numpy()
                for b, mine in enumerate(used):
                    kept = np.isin(own, mine)
                    lengths = np.diff(ends, prepend=0)
                    cells = np.repeat(kept, lengths)
                    lists = [pa.array([x], pa.list_(pa.int32())) for x in (own[kept], np.cumsum(lengths[kept], dtype=np.int32), place[cells], factor[cells])]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), row.column(0), row.column(1), *lists, row.column(6)], columns)

    return map_arrow(postings.select("shard", "size", "terms", "ends", "places", "factors", "ids"), run, "bundle int, shard int, size int, terms array<int>, ends array<int>, places array<int>, factors array<int>, ids array<long>")


@dataclass
class Stage:
    """What a stage knows of the block's queries: who uses a term with which weight, and bounds of each query."""

    uses: dict[int, tuple[np.ndarray, int]]  # term: the queries that have it, its weight
    floor: np.ndarray  # a lower bound of the top-th best score, 0 if none is known
    before: np.ndarray  # what this and later stages add at most
    after: np.ndarray  # what later stages add at most
    top: int

    def add(self, first: int, left: pa.Table, right: pa.Table, queries: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (query, place) after this stage, and which of them can still be among the best; queries count from ``first``."""
        size = right["size"][0].as_py()
        scores, alive = np.zeros((queries, size), np.int64), np.zeros((queries, size), bool)
        here = slice(first, first + queries)
        if left.num_rows:
            cells, met = left["cells"][0].values.to_numpy(), left["scores"][0].values.to_numpy()
            kept = met + self.before[here][cells // size] >= self.floor[here][cells // size]
            scores.ravel()[cells[kept]] = met[kept]
            alive.ravel()[cells[kept]] = True
        admits = self.before >= self.floor
        own, ends = right["terms"][0].values.to_numpy(), right["ends"][0].values.to_numpy()
        place, factor = right["places"][0].values.to_numpy(), right["factors"][0].values.to_numpy()
        for t, a, z in zip(own.tolist(), np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
            users, w = self.uses[t]
            users = users[(users >= first) & (users < first + queries)]
            at, gain = place[a:z], factor[a:z].astype(np.int64) * w
            for q in users.tolist():
                if admits[q]:
                    scores[q - first, at] += gain
                    alive[q - first, at] = True
                else:
                    old = alive[q - first, at]
                    scores[q - first, at[old]] += gain[old]
        alive &= (scores > 0) & (scores + self.after[here][:, None] >= self.floor[here][:, None])
        return scores, alive

    def best(self, scores: np.ndarray, alive: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The places of each query's best scores, ties by place."""
        for q in np.flatnonzero(alive.any(axis=1)).tolist():
            at = np.flatnonzero(alive[q])
            if at.size > self.top:
                least = np.partition(scores[q, at], at.size - self.top)[at.size - self.top]
                at = at[scores[q, at] >= least]
            yield q, at[np.lexsort((at, -scores[q, at]))][: self.top]


def _carried(stage: Stage, queries: int):
    """The cogroup of all stages but the last: accumulators and postings to accumulators."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, shard = key[0].as_py(), key[1].as_py()
        if not right.num_rows:  # every owner has a row in every shard
            return left
        here = min(BUNDLE, queries - bundle * BUNDLE)
        scores, alive = stage.add(bundle * BUNDLE, left, right, here)
        cells = np.flatnonzero(alive.ravel())
        who, floor, count = [], [], []
        for q, at in stage.best(scores, alive):
            s = scores[q, at]
            shift = np.maximum(np.log2(s).astype(np.int64) - 6, 0)  # a floor of seven leading bits
            low, n = np.unique(s >> shift << shift, return_counts=True)
            who.append(np.full(low.size, bundle * BUNDLE + q))
            floor.append(low)
            count.append(n)

        def joined(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        lists = [pa.array([x], pa.list_(kind)) for x, kind in ((cells, pa.int32()), (scores.ravel()[cells], pa.int64()), (joined(who), pa.int32()), (joined(floor), pa.int64()), (joined(count), pa.int32()))]
        return pa.Table.from_arrays([pa.array([bundle], pa.int32()), pa.array([shard], pa.int32()), *lists], ["bundle", "shard", "cells", "scores", "best_query", "best_floor", "best_count"])

    return run


def _selected(stage: Stage, queries: int):
    """The cogroup of the last stage: each query's best documents of a shard."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        first, shard = key[0].as_py() * BUNDLE, key[1].as_py()
        out = {k: [] for k in ("query", "score", "shard", "place", "doc_id")}
        if right.num_rows:
            scores, alive = stage.add(first, left, right, min(BUNDLE, queries - first))
            ids = right["ids"][0].values
            for q, at in stage.best(scores, alive):
                out["query"] += [first + q] * at.size
                out["score"] += scores[q, at].tolist()
                out["place"] += at.tolist()
                out["doc_id"] += ids.take(pa.array(at)).to_pylist()
            out["shard"] = [shard] * len(out["query"])
        return pa.table(out, pa.schema([("query", pa.int32()), ("score", pa.int64()), ("shard", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64())]))

    return run


def _floors(accumulators: DataFrame, queries: int, top: int) -> np.ndarray:
    """For each query a score that ``top`` of its documents have reached, 0 if there are fewer: a number for each query of the block."""
    each = accumulators.select(F.explode(F.arrays_zip("best_query", "best_floor", "best_count")).alias("x")).select("x.*")
    counted = each.groupBy("best_query", "best_floor").agg(F.sum("best_count").alias("c"))
    reached = F.sum("c").over(Window.partitionBy("best_query").orderBy(F.desc("best_floor")))
    floors = np.zeros(queries, np.int64)
    for r in counted.withColumn("reached", reached).where(F.col("reached") >= top).groupBy("best_query").agg(F.max("best_floor").alias("f")).collect():
        floors[r.best_query] = r.f
    return floors


def rank_block(docs: DataFrame, block: Block, scratch: Scratch, id_column: str, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """The best documents of a block's queries."""
    spark, queries = docs.sparkSession, len(block.ids)
    schema = f"{id_column} long, rank int, doc_id long, score long"
    importable(spark)
    found = scratch.save(vectors(docs, block).withColumn("row", F.monotonically_increasing_id()), "vectors")
    stats = found.agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.count_if(F.size("terms") > 0).alias("met")).first()
    if not stats.met:
        return spark.createDataFrame([], schema)
    df = {r.t: r.df for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row for each term of the block
    weights = {t: weight(c, stats.n) for t, c in df.items()}
    owner = np.full(len(block.numbers), len(OWNERS) - 1)
    for t, c in df.items():
        owner[t] = next(i for i, share in enumerate(OWNERS) if c * share <= stats.n)
    # Stages without terms are left out.
    stages = sorted({int(owner[t]) for t in df})
    owner = np.array([stages.index(o) if o in stages else 0 for o in owner.tolist()])
    postings = write_postings(found, scratch, owner, stats.n, stats.total, math.ceil(stats.met / shard))
    scratch.drop("vectors")
    adds = np.zeros((len(stages) + 1, queries), np.int64)
    users: dict[int, list[int]] = {}
    for q, held in enumerate(block.terms):
        for t in held:
            if t in df:
                users.setdefault(t, []).append(q)
                adds[owner[t], q] += weights[t] * MOST_FACTOR
    remaining = np.cumsum(adds[::-1], axis=0)[::-1]
    floors, carried = np.zeros(queries, np.int64), spark.createDataFrame([], _CELLS)
    bundles = math.ceil(queries / BUNDLE)
    for s in range(len(stages)):
        uses = {t: (np.array(who), weights[t]) for t, who in users.items() if owner[t] == s}
        used = [np.array([t for t, (who, _) in uses.items() if ((who >= b * BUNDLE) & (who < (b + 1) * BUNDLE)).any()], np.int32) for b in range(bundles)]
        stage = Stage(uses, floors, remaining[s], remaining[s + 1], top)
        mine = _of_bundles(postings.where(F.col("owner") == s), used)
        met = carried.groupBy("bundle", "shard").cogroup(mine.groupBy("bundle", "shard"))
        if s == len(stages) - 1:
            best = met.applyInArrow(_selected(stage, queries), _FOUND)
            break
        carried = scratch.save(met.applyInArrow(_carried(stage, queries), _CELLS), f"stage-{s}")
        floors = np.maximum(floors, _floors(carried, queries, top))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "shard", "place")
    ids = F.element_at(F.array(*(F.lit(i).cast("long") for i in block.ids)), F.col("query") + 1)
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return scratch.save(ranked.select(ids.alias(id_column), F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def rank(docs: DataFrame, queries: DataFrame, scratch_name: str = "ranking", id_column: str = "item_id", top: int = TOP, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """(id, rank, doc_id, score): the ``top`` documents (doc_id, text) of each query (id, text) with a score above 0."""
    spark = docs.sparkSession
    parts = [rank_block(docs, b, Scratch(spark, scratch_name), id_column, top, shard) for b in blocks(queries, id_column, block_bytes)]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], f"{id_column} long, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM c),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
g AS MATERIALIZED (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // l)))) AS gain FROM f JOIN c USING (r) JOIN w USING (term), s),
a AS (SELECT item_id, r, sum(gain)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM a JOIN c USING (r) QUALIFY rank <= {TOP}"""
