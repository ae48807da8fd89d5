"""The greatest inner products of vectors with many others, exactly.

No product exceeds the product of the lengths. Vectors are therefore met with others in the order of falling length, until the next one's length shows that
nothing better can follow. How far that is, a few of the longest tell beforehand: vectors that need equally much are grouped, and a group gets no
others than it needs. Products are told in single precision with a margin for rounding; what comes near the best is computed again in double precision, so that the result
depends on no order or grouping. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow
from millrace.sources.shared import saved

#: The longest vectors that tell how much each query needs, and queries that go through the others together. Only the work depends on them.
LONGEST, TOGETHER = 4096, 8192
#: Queries and others that are multiplied at once, and how many others begin (each step takes as many as are behind it, up to the most).
ROWS, MOST, FIRST = 1024, 4096, 512
#: Rounding of a product in single precision, as a share of the lengths' product and for each dimension.
ROUNDING = 2.0**-22


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Lists of equally many numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1 if len(column) else 0)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def _needs(longest: np.ndarray, n: int):
    """Adds ``need``: an other that is shorter is none of the row's ``n`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = np.full(batch.num_rows, -1.0)
            if len(longest) >= n and batch.num_rows:
                vectors = _vectors(batch.column("features"))
                lengths, most = _lengths(vectors), _lengths(longest).max()
                for i in range(0, batch.num_rows, ROWS):
                    at = slice(i, i + ROWS)
                    nth = np.partition(vectors[at] @ longest.T, -n, axis=1)[:, -n].astype(np.float64)
                    nth -= ROUNDING * longest.shape[1] * lengths[at] * most
                    need[at] = np.where(nth > 0, nth / np.maximum(lengths[at], 1e-300), -1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(need)], [*batch.schema.names, "need"])

    return run


def _dealt(bounds: list[float]):
    """Rows (group, length, id, features) of queries; group g needs what its bound says at least. Equal needs are dealt to all groups that begin with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, ids = batch.column("need").to_numpy(), batch.column("id").to_numpy()
            low, high = np.searchsorted(bounds, need, "left"), np.searchsorted(bounds, need, "right")
            group = low + ids % (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.nulls(batch.num_rows, pa.float64()), batch.column("id"), batch.column("features")], ["group", "length", "id", "features"])

    return run


class _Best:
    """The best so far of some queries; others come in the order of falling length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n: int) -> None:
        self.ids, self.vectors, self.lengths, self.n = ids, vectors, _lengths(vectors), n
        self.scores = np.full((len(ids), n), -np.inf)
        self.found = np.full((len(ids), n), np.iinfo(np.int64).max)
        self.open, self.seen, self.rounding = np.arange(len(ids)), 0, 0.0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        at = 0
        while at < len(ids) and len(self.open):
            step = slice(at, at + min(MOST, max(FIRST, self.seen)))
            self._step(ids[step], vectors[step])
            self.seen += len(ids[step])
            at = step.stop

    def _step(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        longest = float(_lengths(vectors).max())
        if not self.seen:
            self.rounding = ROUNDING * vectors.shape[1] * longest
        self.open = self.open[self.lengths[self.open] * (longest + self.rounding) >= self.scores[self.open, -1]]
        for i in range(0, len(self.open), ROWS):
            rows = self.open[i : i + ROWS]
            products = self.vectors[rows] @ vectors.T
            floor = self.scores[rows, -1] - self.rounding * self.lengths[rows]
            if len(ids) >= self.n and (new := np.isneginf(floor)).any():
                floor[new] = np.partition(products[new], -self.n, axis=1)[:, -self.n] - 2 * self.rounding * self.lengths[rows[new]]
            x, y = np.divmod(np.flatnonzero(products >= floor.astype(np.float32)[:, None]), len(ids))
            if len(x):
                exact = (self.vectors[rows[x]].astype(np.float64) * vectors[y]).sum(axis=1)
                self._merge(rows[x], exact, ids[y])

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in new ones; rows are in order."""
        good = scores >= self.scores[rows, -1]
        rows, scores, ids = rows[good], scores[good], ids[good]
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        counts = np.diff(np.append(starts, len(rows)))
        changed, line = rows[starts], np.repeat(np.arange(len(starts)), counts)
        place = self.n + np.arange(len(rows)) - starts[line]
        width = self.n + int(counts.max())
        all_scores, all_ids = np.full((len(starts), width), -np.inf), np.full((len(starts), width), np.iinfo(np.int64).max)
        all_scores[:, : self.n], all_ids[:, : self.n] = self.scores[changed], self.found[changed]
        all_scores[line, place], all_ids[line, place] = scores, ids
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.n]
        self.scores[changed], self.found[changed] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def rows(self) -> pa.RecordBatch:
        there = ~np.isneginf(self.scores)
        query = np.repeat(self.ids, there.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.found[there]), pa.array(self.scores[there])], ["query", "id", "score"])


def _met(n: int):
    """The ``n`` best of each query, from rows (group, length, id, features) sorted by group and falling length; queries come first, with length null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None

        def opened() -> _Best:
            return _Best(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), n)

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, ids = batch.column("group").to_numpy(), batch.column("id").to_numpy()
            asks, vectors = batch.column("length").is_null().to_numpy(zero_copy_only=False), _vectors(batch.column("features"))
            edges = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if groups[a] != group:
                    if held:
                        yield (best or opened()).rows()
                    group, held, best = groups[a], [], None
                if asks[a]:
                    held.append((ids[a:b], vectors[a:b]))
                elif held:
                    best = best or opened()
                    best.meet(ids[a:b], vectors[a:b])
        if held:
            yield (best or opened()).rows()

    return run


def best(queries: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """(query, id, score): for each of ``queries`` the ``n`` of ``others`` with the greatest inner product. Both: (id, features), features being floats of one number of dimensions."""
    spark = queries.sparkSession
    length = F.expr("sqrt(aggregate(features, 0D, (s, x) -> s + cast(x AS double) * x))")
    rows = [F.col("id").cast("long").alias("id"), "features"]
    others = saved(others.select(*rows, length.alias("length")), "others")
    longest = others.orderBy(F.desc("length"), "id").limit(max(n, LONGEST)).select("features").toArrow()["features"].combine_chunks()
    asked = queries.select(*rows, length.alias("length"))
    # A query without length ties with all: the smallest ids are its best.
    none = asked.where("length = 0").select(F.col("id").alias("query")).crossJoin(F.broadcast(others.select("id").orderBy("id").limit(n))).withColumn("score", F.lit(0.0))
    needs = saved(map_arrow(asked.where("length > 0").select("id", "features"), _needs(_vectors(longest), n), "id long, features array<float>, need double"), "needs")
    groups = max(1, math.ceil(needs.count() / TOGETHER))
    bounds = needs.approxQuantile("need", [i / groups for i in range(groups)], 0.25 / groups)
    dealt = map_arrow(needs, _dealt(bounds[1:]), "group long, length double, id long, features array<float>")
    least = spark.createDataFrame(list(enumerate(bounds)), "group long, need double")
    sent = others.join(F.broadcast(least), others.length >= least.need).select("group", "length", "id", "features")
    met = dealt.unionByName(sent).repartition(groups, "group").sortWithinPartitions("group", F.desc_nulls_first("length"), "id")
    return map_arrow(met, _met(n), "query long, id long, score double").unionByName(none)
