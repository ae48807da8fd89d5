"""Catalog cleaning: raw product metadata to products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the cleaning rules.
LEAST_TITLE, MOST_PRICE, NAME_CHARS, DESCRIPTION_CHARS, BRAND_CHARS, PER_CATEGORY = 5, 2000.0, 200, 500, 80, 75


def clean(metadata: DataFrame, category: str) -> DataFrame:
    """Products of a category: with a real title, a price in (0, 2000] and an image."""
    price = F.col("price").try_cast("double")
    kept = metadata.where((F.length("title") > LEAST_TITLE) & F.col("price").isNotNull() & (F.col("price") != "None") & (F.size("images.large") > 0) & (price > 0) & (price <= MOST_PRICE))
    brand = F.coalesce(F.nullif(F.col("store"), F.lit("")), F.nullif(F.get_json_object("details", "$.Brand"), F.lit("")), F.lit("Unknown"))
    return kept.select(
        F.substring("title", 1, NAME_CHARS).alias("name"), F.lower(F.translate(F.lit(category), "_", " ")).alias("category"), F.round(price, 2).alias("price"),
        F.substring(F.coalesce(F.get("description", F.lit(0)), F.col("title")), 1, DESCRIPTION_CHARS).alias("description"),
        F.substring(brand, 1, BRAND_CHARS).alias("brand"), F.get("images.large", F.lit(0)).alias("image"),
        F.coalesce(F.col("average_rating"), F.lit(0.0)).alias("rating_average"), F.coalesce(F.col("rating_number"), F.lit(0)).alias("rating_count"), F.col("parent_asin").alias("asin"),
    )


def first_of_each(products: DataFrame, n: int = PER_CATEGORY, order: str = "id") -> DataFrame:
    """The first ``n`` products of each category, in an explicit order."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order))
    return products.withColumn("rank", rank).where(F.col("rank") <= n)
