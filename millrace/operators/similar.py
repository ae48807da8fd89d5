"""Item-to-item collaborative filtering on cosine similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.weights import weight


def interactions(events: DataFrame, unknown: str = "one") -> DataFrame:
    """(user_id, product_id, weight) with weights summed."""
    rows = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    return rows.groupBy("user_id", "product_id").agg(F.sum(weight(F.col("event_type"), unknown)).alias("weight"))


def popular(pairs: DataFrame, n: int | None = 10) -> DataFrame:
    """Items by summed weight, ties by id."""
    totals = pairs.groupBy("product_id").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "product_id")
    return totals.limit(n) if n else totals


#: Items of a user from which on the user's pairs are dealt out, and items of a group that meets another at once.
BUSY, GROUP = 1000, 1000


def cosine(pairs: DataFrame, busy: int = BUSY, group: int = GROUP) -> DataFrame:
    """(a, b, score) for each two items that some user has both of, in both directions.

    Users join with themselves, so items without a common user make no row. Each unordered pair is summed once. Items of users with more than
    ``busy`` are dealt into groups of about ``group``, and each two groups meet by themselves: no user's pairs are one task's work, tasks are as
    many as the square of a basket asks for, and an item goes to no more of them than the user has groups.
    """
    items = F.count("*").over(Window.partitionBy("user_id"))
    groups = F.when(items > busy, F.ceil(items / group)).otherwise(1).cast("int")
    dealt = pairs.withColumn("groups", groups).withColumn("own", F.pmod(F.hash("product_id"), F.col("groups")))
    left = dealt.select("user_id", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("groups") - 1)).alias("j"), F.col("product_id").alias("a"), F.col("weight").alias("wa"))
    right = dealt.select("user_id", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("product_id").alias("b"), F.col("weight").alias("wb"))
    met = left.join(right, ["user_id", "i", "j"]).where("i < j or a < b")
    dots = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    norms = pairs.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scored = dots.join(norms.select(F.col("product_id").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("product_id").alias("b"), F.col("norm").alias("nb")), "b")
    scored = scored.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("score")).where("score > 0")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return scored.select(both, "score").select("x.a", "x.b", "score")


def similar(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar items of each item, ties by id."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def candidates(pairs: DataFrame, scores: DataFrame, neighbours: int = 20) -> DataFrame:
    """(user_id, product_id, score): neighbours of a user's items, without those the user has.

    The cut to the nearest neighbours comes before the user's own items are taken out.
    """
    near = similar(scores, neighbours).select(F.col("a").alias("seed"), F.col("b").alias("product_id"), F.col("score").alias("likeness"))
    met = pairs.select("user_id", F.col("product_id").alias("seed"), "weight").join(near, "seed")
    unseen = met.join(pairs.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    return unseen.groupBy("user_id", "product_id").agg(F.sum(F.col("likeness") * F.col("weight")).alias("score"))


def recommend(pairs: DataFrame, scores: DataFrame, n: int = 5, neighbours: int = 20) -> DataFrame:
    """The ``n`` best candidates of each user, scores rounded to four decimals; ties by id."""
    rounded = candidates(pairs, scores, neighbours).withColumn("score", F.round("score", 4))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= n)


def with_fallback(users: DataFrame, recommended: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """Recommendations of all users: those without any get the popular items (their own included)."""
    top = [(r.product_id, r.score) for r in popular(pairs, n).collect()]  # n rows
    listed = F.array(*(F.struct(F.lit(p).alias("product_id"), F.lit(float(x)).alias("score"), F.lit(i + 1).alias("rank")) for i, (p, x) in enumerate(top)))
    cold = users.select("user_id").distinct().join(recommended.select("user_id").distinct(), "user_id", "left_anti")
    if not top:
        return recommended.select("user_id", "product_id", "score", "rank", F.lit("similar").alias("origin"))
    cold = cold.select("user_id", F.explode(listed).alias("x")).select("user_id", "x.*")
    columns = ["user_id", "product_id", "score", "rank"]
    return recommended.select(*columns, F.lit("similar").alias("origin")).unionByName(cold.select(*columns, F.lit("popular").alias("origin")))


def enriched(recommended: DataFrame, products: DataFrame) -> DataFrame:
    """Recommendations with names and prices; items that the catalog lacks are dropped after the cut."""
    return recommended.join(products.select(F.col("id").cast("int").alias("product_id"), "name", "price"), "product_id")
