"""An inverted index that follows its rows: immutable segments, deletions by tombstone, merges by size tier.

Each batch of changes adds a segment (postings of the new and changed rows, their lengths, and the ids whose older rows no longer hold), and the manifest
``_manifests/N.json`` is written last: a crash before that leaves the index as it was, and a repeated batch does nothing. Once ``fan`` segments of a size
class stand at the end of the list they become one, without what later segments took back, so that a row is rewritten a logarithmic number of times and
a query reads few segments. Postings lie in folders by field and by the term's hash, each written by as many tasks as its segment's rows ask for,
so that a frequent term is no single task's work. Number and length of live rows are kept in the manifest: a batch reads ids and lengths of older rows, never
their postings.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.store import term_slice, term_weight, terms_of, tokens
from millrace.sources.manifests import Manifests, end_to_merge, remove_others

#: Rows of the smallest size class, segments that become one, how classes grow, rows for each task that writes a folder.
LEAST, FAN, GROWTH, WRITE_ROWS = 10_000, 4, 4, 500_000


@dataclass(frozen=True)
class Manifest:
    """Segments from old to new as (folder, rows, tombstones), and (rows, summed length) of each field."""

    version: int
    segments: list[list[int]]
    fields: dict[str, list[int]]


class Index:
    """An index of text fields over rows with a long ``id``."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], least: int = LEAST, fan: int = FAN) -> None:
        self.spark, self.path, self.fields, self.least, self.fan = spark, path, fields, least, fan
        self.manifests = Manifests(spark, path)
        self.lengths = ", ".join(f"len_{i} int" for i in range(len(fields)))

    def manifest(self) -> Manifest:
        """The last manifest."""
        found = self.manifests.last()
        return Manifest(found[0], **found[1]) if found else Manifest(-1, [], {f: [0, 0] for f in self.fields})

    def _read(self, kind: str, schema: str, segments: list[list[int]], counted: int) -> DataFrame:
        """Rows of a kind with ``at``, the place of their segment; segments that have none are left out."""
        there = {s[0]: n for n, s in enumerate(segments) if s[counted]}
        schema = f"{schema}, segment int" + (", field string, slice int" if kind == "terms" else "")
        if not there:
            return self.spark.createDataFrame([], schema).withColumn("at", F.lit(0))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/segment={k}" for k in there))
        return rows.withColumn("at", F.element_at(F.create_map(*(F.lit(x) for pair in there.items() for x in pair)), F.col("segment")))

    def _live(self, rows: DataFrame, segments: list[list[int]]) -> DataFrame:
        """The rows that no later segment took back."""
        if not any(s[2] for s in segments[1:]):
            return rows
        gone = self._read("gone", f"id long, {self.lengths}", segments, 2).groupBy("id").agg(F.max("at").alias("__gone"))
        return rows.join(gone, "id", "left").where(F.col("__gone").isNull() | (F.col("at") >= F.col("__gone"))).drop("__gone")

    def rows(self, segments: list[list[int]] | None = None) -> DataFrame:
        """(id, lengths) of the rows that hold."""
        segments = self.manifest().segments if segments is None else segments
        return self._live(self._read("rows", f"id long, {self.lengths}", segments, 1), segments)

    def postings(self, segments: list[list[int]] | None = None, where: Column | None = None) -> DataFrame:
        """(field, slice, term, id, tf, len) of the rows that hold."""
        segments = self.manifest().segments if segments is None else segments
        met = self._read("terms", "term string, id long, tf int, len int", segments, 1)
        return self._live(met.where(where) if where is not None else met, segments)

    def _write_terms(self, rows: DataFrame, folder: int, n: int) -> None:
        part = F.pmod(F.xxhash64("id"), F.lit(n // WRITE_ROWS + 1))
        rows = rows.select("field", "slice", "term", "id", "tf", "len").repartition("field", "slice", part)
        rows.sortWithinPartitions("field", "slice", "term", "id").write.mode("overwrite").partitionBy("field", "slice").parquet(f"{self.path}/terms/segment={folder}")

    def apply(self, changes: DataFrame, version: int, deleted: str = "deleted") -> None:
        """Takes in a batch: rows of (id, fields..., ``deleted``), one for each id; a deleted one only takes the id's older row back.

        Versions rise from batch to batch; one that the index has taken in already changes nothing.
        """
        now = self.manifest()
        if version <= now.version:
            return
        ids = changes.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"), *self.fields)
        folder, lens = 2 * version, [f"len_{i}" for i in range(len(self.fields))]
        self.rows(now.segments).join(ids.select("id"), "id", "left_semi").select("id", *lens).write.mode("overwrite").parquet(f"{self.path}/gone/segment={folder}")
        cut = ids.where(~F.col("deleted")).select("id", *(tokens(F.col(f)).alias(f"t_{i}") for i, f in enumerate(self.fields)))
        cut.select("id", *(F.size(f"t_{i}").alias(f"len_{i}") for i in range(len(self.fields)))).write.mode("overwrite").parquet(f"{self.path}/rows/segment={folder}")
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in lens]
        (new, gone) = (self.spark.read.schema(f"id long, {self.lengths}").parquet(f"{self.path}/{kind}/segment={folder}").agg(F.count("*"), *sums).first() for kind in ("rows", "gone"))
        if new[0]:
            every = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t_{i}").alias("t")) for i, f in enumerate(self.fields)))
            each = cut.select("id", F.explode(every).alias("x")).select("id", "x.field", F.size("x.t").alias("len"), F.explode("x.t").alias("term"))
            counted = each.groupBy("field", "term", "id", "len").agg(F.count("*").cast("int").alias("tf"))
            self._write_terms(counted.withColumn("slice", term_slice(F.col("term"))), folder, new[0])
        segments = [*now.segments, [folder, new[0], gone[0]]] if new[0] or gone[0] else now.segments
        fields = {f: [now.fields[f][0] + new[0] - gone[0], now.fields[f][1] + new[i + 1] - gone[i + 1]] for i, f in enumerate(self.fields)}
        segments = self._merged(segments, folder + 1)
        self.manifests.write(version, {"segments": segments, "fields": fields})
        for kind in ("terms", "rows", "gone"):
            remove_others(self.spark, f"{self.path}/{kind}", "segment=", {s[0] for s in [*segments, *now.segments]})

    def _merged(self, segments: list[list[int]], folder: int) -> list[list[int]]:
        """The list after the merge it calls for, if any: its longest end of small enough segments, ``fan`` of them or more."""
        first = end_to_merge([n + gone for _, n, gone in segments], self.least, self.fan, GROWTH)
        if first == len(segments):
            return segments
        some = segments[first:]
        lens = [f"len_{i}" for i in range(len(self.fields))]
        self.rows(some).select("id", *lens).write.mode("overwrite").parquet(f"{self.path}/rows/segment={folder}")
        n = self.spark.read.parquet(f"{self.path}/rows/segment={folder}").count()
        if n:
            self._write_terms(self.postings(some), folder, n)
        gone = 0
        if first:  # nothing is older than the first segment
            self._read("gone", f"id long, {self.lengths}", some, 2).groupBy("id").agg(*(F.min(c).alias(c) for c in lens)).write.mode("overwrite").parquet(f"{self.path}/gone/segment={folder}")
            gone = self.spark.read.parquet(f"{self.path}/gone/segment={folder}").count()
        return [*segments[:first], [folder, n, gone]] if n or gone else segments[:first]

    def scores(self, query: str, boosts: Mapping[str, float] | None = None) -> DataFrame:
        """(id, score): the best boosted BM25 of the fields; of the postings only the folders and row groups of the query's terms are read."""
        terms, now = terms_of(query), self.manifest()
        boosts = boosts if boosts is not None else dict.fromkeys(self.fields, 1.0)
        none = self.spark.createDataFrame([], "id long, score double")
        if not terms:
            return none
        slices = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(term_slice(F.col("t"))).collect()]  # a row for each term
        met = self.postings(now.segments, F.col("field").isin(*boosts) & F.col("slice").isin(slices) & F.col("term").isin(terms))
        known = met.groupBy("field", "term").agg(F.count("*").alias("df")).collect()  # a row for each field and term
        if not known:
            return none
        weights = [((F.col("field") == k.field) & (F.col("term") == k.term), term_weight(F.col("tf"), F.col("len"), now.fields[k.field][0], now.fields[k.field][1] / now.fields[k.field][0], k.df) * boosts[k.field]) for k in known]
        gain = reduce(lambda rest, w: F.when(w[0], w[1]).otherwise(rest), weights, F.lit(0.0))
        return met.groupBy("id", "field").agg(F.sum(gain).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
