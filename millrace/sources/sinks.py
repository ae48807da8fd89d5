"""Sinks: archive, keyed tables, exports. Writes are repeatable: the same input leaves the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.schemas import EVENT
from millrace.sources.keyed import read_keyed, upsert
from millrace.sources.tables import with_ids

__all__ = ["read_keyed", "upsert"]


def write_archive(events: DataFrame, path: str) -> None:
    """Appends events to the archive, one folder for each day; a missing time counts as now."""
    day = F.coalesce(F.to_date(F.try_to_timestamp(F.col("created_at").cast("string"))), F.current_date())
    events.withColumn("dt", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def append(spark: SparkSession, path: str, rows: DataFrame, existing: DataFrame, order: str) -> None:
    """Appends new rows to a Parquet table with ids that go on from those of ``existing``."""
    with_ids(rows, existing, order).write.mode("append").parquet(path)


def record_decisions(decisions: DataFrame, path: str) -> None:
    """Appends advisor decisions to the log, one folder for each day; ``metadata`` is JSON text."""
    decisions.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def records(events: DataFrame) -> DataFrame:
    """Events as Kafka records without a key, each the JSON of one event."""
    return events.select(F.to_json(F.struct(*EVENT.names)).alias("value"))


def write_kafka(events: DataFrame, servers: str, topic: str = "events") -> None:
    """Sends events to a topic; needs the Kafka connector's jar (untested here)."""
    records(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_catalog(products: DataFrame, path: str) -> None:
    """Replaces the catalog dump, JSON lines."""
    products.write.mode("overwrite").json(path)


def write_popularity(scores: DataFrame, path: str) -> None:
    """Scores as tab-separated text, best first."""
    scores.orderBy(F.desc("score"), "product_id").write.mode("overwrite").csv(path, sep="\t")


def wide_recommendations(recommendations: DataFrame, n: int = 10) -> DataFrame:
    """One row for each user: cells item_00.. and score_00.. (six decimals), base64 as the key-value store takes them."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")) - 1
    ranked = recommendations.withColumn("rank", rank).where(F.col("rank") < n)
    cells = []
    for i in range(n):
        here = F.col("rank") == i
        cells.append(F.max(F.when(here, F.base64(F.col("product_id").cast("string").cast("binary")))).alias(f"item_{i:02d}"))
        cells.append(F.max(F.when(here, F.base64(F.format_string("%.6f", "score").cast("binary")))).alias(f"score_{i:02d}"))
    return ranked.groupBy("user_id").agg(*cells)


def unpacked(wide: DataFrame, n: int = 10) -> DataFrame:
    """Wide rows back as (user_id, rank, product_id, score), a row for each filled cell."""
    pairs = F.array(*(F.struct(F.lit(i).alias("rank"), F.unbase64(f"item_{i:02d}").cast("string").try_cast("bigint").alias("product_id"), F.unbase64(f"score_{i:02d}").cast("string").try_cast("double").alias("score")) for i in range(n)))
    return wide.select("user_id", F.explode(pairs).alias("x")).select("user_id", "x.*").where(F.col("product_id").isNotNull())


def read_wide(wide: DataFrame, user_id: int, n: int = 10) -> DataFrame:
    """A user's recommendations back from the wide row, best first; no rows for an unknown user."""
    return unpacked(wide.where(F.col("user_id") == user_id), n)
