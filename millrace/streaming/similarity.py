"""Item similarity kept up to date: a batch of events changes the dot products and norms of the pairs it touches, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.similar import interactions
from millrace.sources import keyed
from millrace.streaming.queries import TRIGGER, _started

#: Folders that users, first items and items are dealt into; a batch rewrites those it touches.
SLICES = 16


def _sliced(rows: DataFrame, key: str, slices: int) -> DataFrame:
    return rows.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))


class Similarity:
    """Weights by (user, item), dot products by (a < b) and square norms by item, as keyed tables under a folder.

    With w and w' a user's weights before and after a batch, a dot product changes by the sum of w'a w'b - wa wb over the users whose a or b changed: the batch's
    rows join with the baskets of their users only. All three tables take a batch under its number; one that is given again is taken from the tables as
    they stood before it.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = SLICES) -> None:
        self.spark, self.root, self.slices = spark, root, slices

    def _table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        found = keyed.read_keyed(self.spark, f"{self.root}/{name}", "slice", before)
        return found if found is not None else self.spark.createDataFrame([], f"{schema}, slice int")

    def weights(self, before: int | None = None) -> DataFrame:
        return self._table("weights", "user_id int, product_id int, weight double", before)

    def dots(self, before: int | None = None) -> DataFrame:
        return self._table("dots", "a int, b int, dot double", before)

    def norms(self, before: int | None = None) -> DataFrame:
        return self._table("norms", "product_id int, square double", before)

    def apply(self, events: DataFrame, version: int) -> None:
        """Takes in a batch of events."""
        new = interactions(events).select("user_id", "product_id", F.col("weight").alias("more"))
        users = _sliced(new.select("user_id").distinct(), "user_id", self.slices)
        # Only the folders and baskets of the batch's users are read.
        old = self.weights(version).join(users, ["slice", "user_id"], "left_semi").select("user_id", "product_id", "weight")
        both = old.join(new, ["user_id", "product_id"], "full").select("user_id", "product_id", F.coalesce("weight", F.lit(0.0)).alias("was"), (F.coalesce("weight", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("now"))
        changed = both.where("now <> was")
        x = changed.select("user_id", F.col("product_id").alias("p"), F.col("was").alias("p0"), F.col("now").alias("p1"))
        y = both.select("user_id", F.col("product_id").alias("q"), F.col("was").alias("q0"), F.col("now").alias("q1"))
        # A pair of two changed items meets twice and counts once.
        met = x.join(y, "user_id").where((F.col("p") < F.col("q")) | ((F.col("p") > F.col("q")) & (F.col("q0") == F.col("q1"))))
        gains = met.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(F.col("p1") * F.col("q1") - F.col("p0") * F.col("q0")).alias("gain"))
        squares = changed.groupBy("product_id").agg(F.sum(F.col("now") * F.col("now") - F.col("was") * F.col("was")).alias("gain"))
        self._add("dots", self.dots(version), _sliced(gains, "a", self.slices), ["a", "b"], "dot", version)
        self._add("norms", self.norms(version), _sliced(squares, "product_id", self.slices), ["product_id"], "square", version)
        kept = _sliced(changed.select("user_id", "product_id", F.col("now").alias("weight")), "user_id", self.slices)
        keyed.upsert(self.spark, f"{self.root}/weights", kept, ["user_id", "product_id"], "slice", version)

    def _add(self, name: str, old: DataFrame, gains: DataFrame, keys: list[str], value: str, version: int) -> None:
        """Adds gains to a table's values."""
        met = gains.join(old.drop("slice"), keys, "left")
        rows = met.select(*keys, (F.coalesce(value, F.lit(0.0)) + F.col("gain")).alias(value), "slice")
        keyed.upsert(self.spark, f"{self.root}/{name}", rows, keys, "slice", version)

    def cosine(self) -> DataFrame:
        """(a, b, score) in both directions, as the batch form gives it."""
        norms = self.norms().select("product_id", F.sqrt("square").alias("norm"))
        scored = self.dots().join(norms.select(F.col("product_id").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("product_id").alias("b"), F.col("norm").alias("nb")), "b")
        scored = scored.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("score")).where("score > 0")
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
        return scored.select(both, "score").select("x.a", "x.b", "score")


def write_similarity(events: DataFrame, root: str, checkpoint: str, once: bool = False, slices: int = SLICES) -> StreamingQuery:
    """Keeps item similarity as events arrive."""

    def put(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            Similarity(batch.sparkSession, root, slices).apply(batch, n)

    return _started(events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint), once, TRIGGER).start()
