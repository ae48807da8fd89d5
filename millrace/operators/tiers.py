"""Demand in two tiers: minutes of hot products, hours of cold ones, and a reader that unites them.

Every count lives in one tier only. A roll takes in closed minute counts, judges each product anew, writes the strategies that changed, and moves the minutes of
cold products into hours; what is in hours stays there when a product gets hot again. All three tables take a roll under its number and can be
given it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tuning import HOT_EVENTS, LOOKBACK_MINUTES, changes
from millrace.sources import keyed


class Tiers:
    """The tables ``minutes`` and ``hours`` by day and ``strategies`` by slice of the product, under a folder."""

    def __init__(self, spark: SparkSession, root: str, hot: int = HOT_EVENTS, lookback: int = LOOKBACK_MINUTES, slices: int = 8) -> None:
        self.spark, self.root, self.hot, self.lookback, self.slices = spark, root, hot, lookback, slices

    def _table(self, name: str, partition: str, schema: str, before: int | None = None) -> DataFrame:
        found = keyed.read_keyed(self.spark, f"{self.root}/{name}", partition, before)
        return found if found is not None else self.spark.createDataFrame([], schema)

    def minutes(self, before: int | None = None) -> DataFrame:
        return self._table("minutes", "bucket_date", "product_id int, bucket timestamp_ntz, event_count long, bucket_date date", before)

    def hours(self, before: int | None = None) -> DataFrame:
        return self._table("hours", "bucket_date", "product_id int, event_hour int, event_count long, bucket_date date", before)

    def strategies(self, before: int | None = None) -> DataFrame:
        """(product_id, granularity, recent_volume, since): since which moment a product is hot or cold."""
        return self._table("strategies", "slice", "product_id int, granularity string, recent_volume long, since timestamp_ntz, slice int", before).drop("slice")

    def roll(self, counts: DataFrame, now, version: int) -> None:
        """Takes in closed minutes (product_id, bucket_date, bucket, event_count), each of them once, as of the moment ``now``."""
        now = F.lit(now).cast("timestamp_ntz")
        since = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(self.lookback))
        new = counts.select("product_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.col("event_count").cast("long").alias("event_count"), "bucket_date")
        there = self.minutes(version)
        every = there.select(new.columns).unionByName(new)
        recent = F.sum(F.when((F.col("bucket") >= since) & (F.col("bucket") <= now), F.col("event_count")).otherwise(0))
        # Products without minutes of their own in either part are cold already.
        judged = every.groupBy("product_id").agg(recent.alias("recent_volume")).withColumn("granularity", F.when(F.col("recent_volume") >= self.hot, "hot").otherwise("cold"))
        turned = changes(judged, self.strategies(version)).select("product_id", "granularity", "recent_volume", now.alias("since"))
        keyed.upsert(self.spark, f"{self.root}/strategies", turned.withColumn("slice", F.pmod(F.xxhash64("product_id"), F.lit(self.slices)).cast("int")), ["product_id"], "slice", version)
        told = self.strategies().select("product_id", "granularity")
        marked = every.join(told, "product_id")
        moved = marked.where("granularity = 'cold'").groupBy("product_id", "bucket_date", F.hour("bucket").alias("event_hour")).agg(F.sum("event_count").alias("more"))
        summed = moved.join(self.hours(version), ["product_id", "bucket_date", "event_hour"], "left")
        summed = summed.select("product_id", "event_hour", (F.col("more") + F.coalesce("event_count", F.lit(0))).alias("event_count"), "bucket_date")
        keyed.upsert(self.spark, f"{self.root}/hours", summed, ["product_id", "bucket_date", "event_hour"], "bucket_date", version)
        # Written: new minutes of hot products; taken out: old ones of products that are cold now.
        fresh = new.join(told.where("granularity = 'hot'"), "product_id", "left_semi").withColumn("gone", F.lit(False))
        left = there.join(told.where("granularity = 'cold'"), "product_id", "left_semi").select(new.columns).withColumn("gone", F.lit(True))
        keyed.upsert(self.spark, f"{self.root}/minutes", fresh.unionByName(left), ["product_id", "bucket"], "bucket_date", version, "gone")

    def by_hour(self) -> DataFrame:
        """(product_id, bucket_date, event_hour, event_count) of all products, whatever their strategies were."""
        fine = self.minutes().select("product_id", "bucket_date", F.hour("bucket").alias("event_hour"), "event_count")
        both = fine.unionByName(self.hours().select(fine.columns))
        return both.groupBy("product_id", "bucket_date", "event_hour").agg(F.sum("event_count").alias("event_count"))

    def series(self, product_id: int) -> DataFrame:
        """A product's counts by its strategy, latest first: minutes where they are kept, hours before that."""
        fine = self.minutes().where(F.col("product_id") == product_id).select("bucket", F.lit("minute").alias("grain"), "event_count")
        start = F.to_timestamp_ntz(F.concat("bucket_date", F.lit(" "), F.lpad(F.col("event_hour").cast("string"), 2, "0"), F.lit(":00:00")))
        coarse = self.hours().where(F.col("product_id") == product_id).select(start.alias("bucket"), F.lit("hour").alias("grain"), "event_count")
        return fine.unionByName(coarse).orderBy(F.desc("bucket"))
