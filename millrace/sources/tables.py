"""Sources: files of events, clickstreams, products and recommendations, and the adapters from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.schemas import CLICKSTREAM, EVENT, EVENT_TYPES, METADATA, PRODUCT, RECOMMENDATION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in canonical form: clicks are additions to the cart, signups and errors stay unknown types."""
    raw = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "add_to_cart").otherwise(F.col("event_type"))
    product = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    return raw.select(F.col("event_id").alias("id"), "user_id", product.alias("product_id"), kind.alias("event_type"), F.col("ts").alias("created_at"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as nested documents, from the parts table."""
    part = table(spark, sf_dir, "part")
    # Stock stands on a grid of 50 by 20 degrees, told by the key.
    spot = F.array((F.col("p_partkey") * 7 % 50 - 110).cast("double"), (F.col("p_partkey") * 11 % 20 + 30).cast("double"))
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.lit("").alias("description"),
        F.array("p_type", "p_brand").alias("tags"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("specifications"),
        F.array(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("images"),
        F.struct(F.lit("Point").alias("type"), spot.alias("coordinates")).alias("location"),
        F.struct((F.col("p_size") % 50 / 10.0).alias("average"), F.col("p_size").cast("int").alias("count")).alias("rating"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("asin"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their country, from customers and nations."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    email = F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    return joined.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), email.alias("email"), F.coalesce("n_name", F.lit("")).alias("country"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions of the large scale: (user_id, product_id, weight)."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id")).agg(F.sum("l_quantity").alias("weight"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The day-partitioned JSON archive; lines that are no events come back as nulls and are left out."""
    rows = spark.read.schema(EVENT).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.coalesce("id", "user_id", "product_id", "event_type", "created_at").isNotNull())


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events from a text column ``value``, one JSON object each; blank and malformed lines are left out."""
    parsed = lines.where(F.length(F.trim("value")) > 0).select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")
    return parsed.where(F.coalesce("id", "user_id", "product_id", "event_type", "created_at").isNotNull())


def read_clickstream(spark: SparkSession, path: str) -> DataFrame:
    """A clickstream CSV with a header and a declared schema."""
    return spark.read.schema(CLICKSTREAM).option("header", True).csv(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products from a file that holds one JSON array."""
    return spark.read.schema(PRODUCT).option("multiLine", True).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Product metadata; only the columns a query names are read."""
    return spark.read.schema(METADATA).parquet(path)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """Exported recommendations, JSON lines."""
    return spark.read.schema(RECOMMENDATION).json(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table; the driver's jar must be on the class path (untested here)."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def timed(events: DataFrame) -> DataFrame:
    """Adds ``event_time``, which the windowed streams go by; null where ``created_at`` is no time."""
    return events.withColumn("event_time", F.try_to_timestamp("created_at"))


def kafka_events(raw: DataFrame) -> DataFrame:
    """Events with ``event_time`` from Kafka records, whose ``value`` is the JSON of one event as bytes."""
    return timed(parse_lines(raw.select(F.col("value").cast("string").alias("value"))))


def stream_kafka(spark: SparkSession, servers: str, topic: str = "events", start: str = "latest", most: int | None = None) -> DataFrame:
    """The event topic as a stream with ``event_time``; needs the Kafka connector's jar (untested here).

    start: ``latest``, or ``earliest`` for a replay; most: records of one batch. Lost offsets don't end the stream.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).option("failOnDataLoss", "false")
    return kafka_events((reader.option("maxOffsetsPerTrigger", most) if most else reader).load())


def read_kafka(spark: SparkSession, servers: str, topic: str = "events") -> DataFrame:
    """All that the topic holds, from its earliest offset, as a batch (untested here)."""
    return kafka_events(spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "false").load())


def stream_files(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Events from JSON files as they arrive, with ``event_time``."""
    return timed(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(path))


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    """Exported scores, tab-separated (product_id, score); lines that are no such pair are left out."""
    rows = spark.read.schema("product_id INT, score BIGINT").csv(path, sep="\t")
    return rows.where(F.col("product_id").isNotNull() & F.col("score").isNotNull())


def generate_events(spark: SparkSession, count: int, users: int, products: int, seed: int = 42) -> DataFrame:
    """Made events, six views to three additions to one purchase, uniform over users and products."""
    draw = F.rand(seed)
    base = spark.range(count).withColumn("r", draw)
    kind = F.when(F.col("r") < 0.6, EVENT_TYPES[0]).when(F.col("r") < 0.9, EVENT_TYPES[1]).otherwise(EVENT_TYPES[2])
    return base.select(
        F.expr("uuid()").alias("id"),
        (F.floor(F.rand(seed + 1) * users) + 1).cast("int").alias("user_id"),
        (F.floor(F.rand(seed + 2) * products) + 1).cast("int").alias("product_id"),
        kind.alias("event_type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
    )


def with_ids(rows: DataFrame, existing: DataFrame, order: str, deals: int = 64) -> DataFrame:
    """New rows numbered on from the greatest id there is, in ``order`` (whose values differ, null first); an ``id`` they have is replaced.

    Numbers are dense and repeatable: rows are dealt into ranges of ``order``, split at ``deals`` of its values (those of least hash), the ranges
    are counted, and each numbers its rows from the sum before it. No task takes all rows.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("m")).first().m
    rows = rows.drop("id")
    cuts = sorted(r[0] for r in rows.where(F.col(order).isNotNull()).select(order).distinct().orderBy(F.xxhash64(order), order).limit(deals - 1).collect())
    within = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(within))
    counted = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    sums = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    before = counted.select("__range", F.coalesce(sums, F.lit(0)).alias("__before"))  # a row for each range
    here = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    numbered = dealt.join(F.broadcast(before), "__range").withColumn("__n", here)
    return numbered.withColumn("id", F.lit(top) + F.col("__before") + F.col("__n")).drop("__range", "__before", "__n")
