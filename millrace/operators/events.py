"""Event validation, popularity, counters and the dashboard's pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.schemas import EVENT_TYPES
from millrace.functions.weights import weight


def reason(user_id: Column, product_id: Column, event_type: Column) -> Column:
    """Why an event is refused, or null; numeric strings count as numbers."""
    return (
        F.when(user_id.isNull() | product_id.isNull() | event_type.isNull(), "missing")
        .when(user_id.cast("string").try_cast("bigint").isNull() | product_id.cast("string").try_cast("bigint").isNull(), "not_a_number")
        .when(~event_type.isin(*EVENT_TYPES), "unknown_type")
    )


def validate(events: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``."""
    why = reason(F.col("user_id"), F.col("product_id"), F.col("event_type"))
    return events.withColumn("reason", why).withColumn("valid", F.col("reason").isNull())


def ingest(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): accepted events get ids and times where they have none."""
    checked = validate(events)
    accepted = checked.where("valid").drop("valid", "reason")
    return accepted, checked.where("not valid").drop("valid")


def popularity(events: DataFrame) -> DataFrame:
    """(product_id, score): weights summed; unknown types and events without a product are dropped."""
    known = events.withColumn("w", weight(F.col("event_type"), "drop")).where(F.col("w").isNotNull() & F.col("product_id").isNotNull())
    return known.groupBy("product_id").agg(F.sum("w").cast("bigint").alias("score"))


def product_counters(events: DataFrame) -> DataFrame:
    """Views, additions and purchases of each product; unknown types count nowhere."""
    known = events.where(F.col("event_type").isin(*EVENT_TYPES))
    names = {"view": "views", "add_to_cart": "add_to_carts", "purchase": "purchases"}
    return known.groupBy("product_id").agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in names.items()))


def top_products(counters: DataFrame, n: int = 10) -> DataFrame:
    """The best products by weighted counts, ties by id."""
    score = F.col("views") + 3 * F.col("add_to_carts") + 5 * F.col("purchases")
    return counters.withColumn("score", score).orderBy(F.desc("score"), "product_id").limit(n)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events of each day and type, unknown types included."""
    return events.groupBy(F.to_date("created_at").alias("day"), "event_type").agg(F.count("*").alias("count"))


def daily_summary(counts: DataFrame, rows: int = 90) -> DataFrame:
    """The latest rows (not days) of the daily counts."""
    return counts.orderBy(F.desc("day"), "event_type").limit(rows)


def daily_pivot(counts: DataFrame, kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """A row for each day, a column for each type, 0 where none."""
    return counts.groupBy("day").pivot("event_type", list(kinds)).agg(F.sum("count")).fillna(0, list(kinds))


def named(rows: DataFrame, products: DataFrame, width: int = 28) -> DataFrame:
    """Rows with their product's name, cut to ``width`` with an ellipsis; rows without a product in the catalog are dropped."""
    label = F.when(F.length("name") > width, F.concat(F.substring("name", 1, width), F.lit("…"))).otherwise(F.col("name"))
    return rows.join(products.select(F.col("id").cast("int").alias("product_id"), label.alias("name")), "product_id")
