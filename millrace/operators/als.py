"""Implicit matrix factorisation: eligibility, split, training, precision and export."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.weights import CLICKSTREAM_WEIGHTS, weight
from millrace.operators.inner_products import best

#: Fixed values of the model.
RANK, ROUNDS, REGULARISATION, ALPHA, SEED, TOP, LEAST_ITEMS = 10, 10, 0.1, 1.0, 42, 10, 5


def clickstream_pairs(clicks: DataFrame) -> DataFrame:
    """(user_id, product_id, weight) of a clickstream; unknown events weigh nothing but keep their row."""
    w = weight(F.col("event"), "zero", CLICKSTREAM_WEIGHTS)
    return clicks.groupBy(F.col("visitorid").alias("user_id"), F.col("itemid").alias("product_id")).agg(F.sum(w).alias("weight"))


def eligible(pairs: DataFrame, least: int = LEAST_ITEMS) -> DataFrame:
    """(user_id, n): users with at least ``least`` different items."""
    return pairs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def held_out(user_id: Column, product_id: Column) -> Column:
    """One pair in five, told by its ids, so that any engine makes the same split."""
    digest = F.md5(F.concat_ws(":", user_id.cast("string"), product_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 5 == 0


def split(pairs: DataFrame, least: int = LEAST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(train, test): eligible users are split, all others train."""
    users = eligible(pairs, least).select("user_id")
    tested = pairs.join(users, "user_id").withColumn("out", held_out(F.col("user_id"), F.col("product_id")))
    rest = pairs.join(users, "user_id", "left_anti")
    return tested.where("not out").drop("out").unionByName(rest), tested.where("out").drop("out")


def fit(train: DataFrame) -> ALSModel:
    """The implicit-feedback model; ids must fit in 32 bits."""
    als = ALS(rank=RANK, maxIter=ROUNDS, regParam=REGULARISATION, alpha=ALPHA, seed=SEED, implicitPrefs=True, coldStartStrategy="drop", userCol="user_id", itemCol="product_id", ratingCol="weight")
    return als.fit(train.select(F.col("user_id").cast("int").alias("user_id"), F.col("product_id").cast("int").alias("product_id"), F.col("weight").cast("float").alias("weight")))


def top(model: ALSModel, users: DataFrame, n: int) -> DataFrame:
    """(user_id, product_id, score): the model's ``n`` best items of the given users, seen items included; ties by id."""
    wanted = users.select(F.col("user_id").cast("int").alias("id")).distinct()
    return best(model.userFactors.join(wanted, "id", "left_semi"), model.itemFactors, n).withColumnsRenamed({"query": "user_id", "id": "product_id"})


def precision(model: ALSModel, train: DataFrame, test: DataFrame, k: int = TOP) -> DataFrame:
    """(precision, users): hits among k unseen items / k, over users with both lists; 0 users give 0.

    Three times as many items are fetched, those of the training set dropped, and the best k kept.
    """
    fetched = top(model, test.select("user_id"), 3 * k)
    unseen = fetched.join(train.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id"))
    best = unseen.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("user_id").agg(F.collect_set("product_id").alias("best"))
    real = test.groupBy("user_id").agg(F.collect_set(F.col("product_id").cast("bigint")).alias("real"))
    hits = best.join(real, "user_id").select((F.size(F.array_intersect("best", "real")) / F.lit(k)).alias("p"))
    return hits.agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("precision"), F.count("*").alias("users"))


def save(model: ALSModel, path: str) -> None:
    """Replaces a stored model."""
    model.write().overwrite().save(path)


def load(path: str) -> ALSModel:
    """A stored model."""
    return ALSModel.load(path)


def export(spark: SparkSession, recommendations: DataFrame, path: str) -> None:
    """Replaces the exported recommendations, JSON lines."""
    recommendations.select(F.col("user_id").alias("visitorid"), F.col("product_id").alias("itemid"), "score").write.mode("overwrite").json(path)
