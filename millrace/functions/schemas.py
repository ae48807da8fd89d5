"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("user_id", T.IntegerType()),
        T.StructField("product_id", T.IntegerType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
CLICKSTREAM = "timestamp BIGINT, visitorid BIGINT, event STRING, itemid BIGINT, transactionid STRING"
PRODUCT = (
    "id INT, name STRING, category STRING, price DOUBLE, description STRING, tags ARRAY<STRING>, specifications MAP<STRING,STRING>, images ARRAY<STRING>, "
    "location STRUCT<type:STRING,coordinates:ARRAY<DOUBLE>>, rating STRUCT<average:DOUBLE,count:INT>, asin STRING"
)
USER = "id INT, username STRING, email STRING, country STRING"
RECOMMENDATION = "visitorid BIGINT, itemid BIGINT, score DOUBLE"
DEMAND = "product_id INT, bucket_date DATE, event_minute TIMESTAMP, event_count INT"
STATEMENT = "queryid BIGINT, datname STRING, query STRING, calls BIGINT"
DECISION = "ts TIMESTAMP, store STRING, action STRING, target STRING, reason STRING, metadata STRING"
METADATA = (
    "title STRING, price STRING, store STRING, details STRING, description ARRAY<STRING>, images STRUCT<large:ARRAY<STRING>>, average_rating DOUBLE, rating_number BIGINT, parent_asin STRING"
)
EVENT_TYPES = ("view", "add_to_cart", "purchase")
