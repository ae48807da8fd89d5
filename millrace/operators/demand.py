"""Sessions, demand series and running z-scores; batch and stream share these expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, LEAST = 2.5, 3


def sessions(events: DataFrame, gap: str = "5 minutes", time: str = "created_at") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("event_count"), F.sort_array(F.collect_list("product_id")).alias("products"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count", "products")


def counts(events: DataFrame, grain: str = "minute", time: str = "created_at") -> DataFrame:
    """(product_id, bucket_date, bucket, event_count) by minute, hour or day."""
    at = F.window(time, f"1 {grain}")["start"]
    grouped = events.where(F.col("product_id").isNotNull()).groupBy(at.alias("bucket"), "product_id").agg(F.count("*").alias("event_count"))
    return grouped.select("product_id", F.to_date("bucket").alias("bucket_date"), "bucket", "event_count")


def series(minutes: DataFrame, product_id: int, day, days: int = 1) -> DataFrame:
    """A product's counts of a day and the ``days`` before it, latest first."""
    day = F.lit(day).cast("date")
    wanted = (F.col("product_id") == product_id) & (F.col("bucket_date") <= day) & (F.col("bucket_date") >= F.date_sub(day, days))
    return minutes.where(wanted).orderBy(F.desc("bucket"))


def hourly(minutes: DataFrame) -> DataFrame:
    """Minute counts rolled up to hours."""
    return minutes.groupBy("product_id", "bucket_date", F.hour("bucket").alias("event_hour")).agg(F.sum("event_count").alias("event_count"))


def z_scores(buckets: DataFrame) -> DataFrame:
    """Each count against its product's earlier ones, once there are ``LEAST`` that differ.

    With n counts of sum S and square sum Q before it, z = (n c - S) / sqrt(n Q - S S): whole numbers up to the root, of 38
    digits, so that busy products over years stay exact.
    """
    before = Window.partitionBy("product_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x.cast("decimal(28,0)")).over(before), F.lit(0)).cast("decimal(38,0)")

    c = F.col("event_count").cast("decimal(18,0)")
    frame = buckets.withColumn("n", F.count("*").over(before)).withColumn("s", total(c)).withColumn("q", total(c * c))

    def times(x: Column, y: Column) -> Column:
        return (x.cast("decimal(19,0)") * y.cast("decimal(38,0)")).cast("decimal(38,0)")

    spread = times(F.col("n"), F.col("q")) - times(F.col("s"), F.col("s"))
    known = frame.where((F.col("n") >= LEAST) & (spread > 0))
    rise = times(F.col("n"), c) - F.col("s")
    return known.select("product_id", "bucket", "event_count", (rise.cast("double") / F.sqrt(spread.cast("double"))).alias("z"))


def anomalies(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores beyond the threshold on either side."""
    return scores.where(F.abs("z") > threshold)
