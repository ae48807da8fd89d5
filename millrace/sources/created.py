"""Catalog tables that are made where they are missing, bucketed and sorted by key so that joins on the key move no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Table:
    """A table's columns, the key it is bucketed and sorted by, and its number of buckets."""

    name: str
    columns: str
    key: str
    buckets: int = 16


#: The tables that the engine keeps.
DEMAND = Table("demand_by_minute", "product_id INT, bucket_date DATE, event_minute TIMESTAMP_NTZ, event_count BIGINT", "product_id")
DAYS = Table("products_by_day", "bucket_date DATE, product_id INT", "product_id")
COUNTERS = Table("product_counters", "product_id INT, views BIGINT, add_to_carts BIGINT, purchases BIGINT", "product_id")
NAMES = Table("product_names", "product_id INT, name STRING, price DOUBLE", "product_id")
TABLES = (DEMAND, DAYS, COUNTERS, NAMES)


def ensure(spark: SparkSession, database: str, root: str, *tables: Table) -> None:
    """Makes the database and the tables that are missing, under ``root``; those that are there stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")
    for t in tables or TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{t.name}` ({t.columns}) USING parquet CLUSTERED BY ({t.key}) SORTED BY ({t.key}) INTO {t.buckets} BUCKETS LOCATION '{root}/{t.name}'")


def insert(rows: DataFrame, database: str, table: Table) -> None:
    """Appends rows: one file for each bucket, whatever the number of tasks before."""
    names = [f.name for f in rows.sparkSession.table(f"`{database}`.`{table.name}`").schema]
    dealt = rows.select(*names).repartition(table.buckets, table.key)
    dealt.write.insertInto(f"`{database}`.`{table.name}`")
