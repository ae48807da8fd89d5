"""Registry of the engine's queries over the driver's tables, each beside the SQL that DuckDB answers it with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.schemas import EVENT_TYPES
from millrace.operators import als, cleaning, demand, events, similar, store, tuning
from millrace.plans import fixtures
from millrace.sources import sinks, tables
from millrace.sources.shared import fresh_path, saved
from millrace.streaming import queries as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapters of ``sources.tables``, in SQL.
EV = "ev AS (SELECT event_id AS id, user_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS product_id, CASE event_type WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type, ts AS created_at FROM events)"
PR = "pr AS (SELECT p_partkey AS id, p_name AS name, lower(p_type) AS category, p_brand AS brand, p_retailprice AS price, [p_type, p_brand] AS tags, (p_size % 50) / 10.0::DOUBLE AS rating_average, p_size::INT AS rating_count, [(p_partkey * 7 % 50 - 110)::DOUBLE, (p_partkey * 11 % 20 + 30)::DOUBLE] AS spot, 'part/' || p_partkey AS image, 'P' || p_partkey AS asin FROM part)"
US = "us AS (SELECT c_custkey AS id, c_name AS username, lower(replace(c_name, '#', '.')) || '@example.com' AS email, coalesce(n_name, '') AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"
W1 = "CASE event_type WHEN 'view' THEN 1.0 WHEN 'add_to_cart' THEN 3.0 WHEN 'purchase' THEN 5.0 ELSE {} END::DOUBLE"
IX = f"{EV}, ix AS (SELECT user_id, product_id, sum({W1.format('1.0')}) AS weight FROM ev WHERE user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY ALL)"
COS = f"{IX}, nm AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM ix GROUP BY ALL), dt AS (SELECT x.product_id AS a, y.product_id AS b, sum(x.weight * y.weight) AS dot FROM ix x JOIN ix y USING (user_id) WHERE x.product_id <> y.product_id GROUP BY ALL), cs AS (SELECT a, b, dot / (p.norm * q.norm) AS score FROM dt JOIN nm p ON p.product_id = a JOIN nm q ON q.product_id = b WHERE dot > 0)"
REC = f"{COS}, nb AS (SELECT a, b, score FROM cs QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 20), cd AS (SELECT i.user_id, n.b AS product_id, round(sum(n.score * i.weight), 4) AS score FROM ix i JOIN nb n ON n.a = i.product_id ANTI JOIN ix h ON h.user_id = i.user_id AND h.product_id = n.b GROUP BY ALL), rc AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id)::INT AS rank FROM cd QUALIFY rank <= 5)"
DEM = EV + ", dm AS (SELECT product_id, date_trunc('{}', created_at)::DATE AS bucket_date, date_trunc('{}', created_at) AS bucket, count(*) AS event_count FROM ev WHERE product_id IS NOT NULL GROUP BY ALL)"
LARGE = "lg AS (SELECT o_custkey AS user_id, l_partkey AS product_id, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
STATEMENTS = f"st(cycle, queryid, query, calls) AS (VALUES {fixtures.values(fixtures.STATEMENTS)}), dl AS (SELECT *, coalesce(greatest(calls - lag(calls) OVER (PARTITION BY queryid ORDER BY cycle), 0), 0) AS delta, CASE WHEN lower(regexp_extract(query, '^\\s*([A-Za-z]+)', 1)) IN ('select', 'insert', 'update', 'delete') THEN lower(regexp_extract(query, '^\\s*([A-Za-z]+)', 1)) ELSE 'other' END AS kind FROM st)"
#: Comments count as blanks.
STATEMENTS = STATEMENTS.replace("FROM st)", "FROM (SELECT cycle, queryid, regexp_replace(query, '(?s)--[^\\n]*|/\\*.*?\\*/', ' ', 'g') AS query, calls FROM st))")
PREDICATES = f"""{STATEMENTS}, tk AS (SELECT queryid, regexp_extract_all(regexp_extract(query, '(?is)\\bwhere\\b(.*)', 1), '{tuning.TOKEN}') AS t FROM (SELECT DISTINCT queryid, query, kind FROM dl) WHERE kind = 'select'),
tp AS (SELECT queryid, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
pd AS (SELECT queryid, t[i] AS "table", t[i + 2] AS "column", CASE WHEN t[i + 4][1] = '$' THEN upper(t[i + 3]) ELSE upper(t[i + 3] || ' ' || t[i + 4]) END AS operator FROM tp
  WHERE t[i + 1] = '.' AND (t[i + 4][1] = '$' OR t[i + 5][1] = '$') AND operator IN ({", ".join(f"'{o}'" for o in tuning.OPERATORS)}) AND regexp_matches(t[i], '^[A-Za-z_]') AND regexp_matches(t[i + 2], '^[A-Za-z_]'))"""
#: The moment the time-bound queries look back from, and products and users they ask for.
NOW, DAY, PRODUCT = "2024-01-15 12:00:00", "2024-01-15", 7


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {sql}"
        return f

    return put


# Ingestion and archive


@query(f"{EV} SELECT id, CASE WHEN user_id IS NULL OR product_id IS NULL OR event_type IS NULL THEN 'missing' WHEN event_type NOT IN ('view', 'add_to_cart', 'purchase') THEN 'unknown_type' END AS reason, event_type IN ('view', 'add_to_cart', 'purchase') AND user_id IS NOT NULL AND product_id IS NOT NULL AS valid FROM ev")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.validate(tables.events(spark, sf_dir)).select("id", "reason", "valid")


@query(f"{EV} SELECT strftime(created_at, '%Y-%m-%d') AS dt, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL")
def archive_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    rows = tables.events(spark, sf_dir)
    sinks.write_archive(rows.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("int").alias("user_id"), "product_id", "event_type", F.col("created_at").cast("string").alias("created_at")), path)
    back = tables.read_archive(spark, path)
    return back.groupBy(F.col("dt").cast("string").alias("dt"), "event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query(f"{EV} SELECT event_type, count(*) AS events, sum(product_id)::BIGINT AS product_sum FROM ev GROUP BY ALL")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.events(spark, sf_dir).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "user_id", "product_id", "event_type", F.col("created_at").cast("string").alias("created_at"))).alias("value"))
    return tables.parse_lines(lines).groupBy("event_type").agg(F.count("*").alias("events"), F.sum("product_id").alias("product_sum"))


# Popularity and counters


@query(f"{EV} SELECT product_id, sum({W1.format('NULL')})::BIGINT AS score FROM ev WHERE event_type IN ('view', 'add_to_cart', 'purchase') AND product_id IS NOT NULL GROUP BY ALL")
def popularity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.popularity(tables.events(spark, sf_dir))


COUNTERS = f"{EV}, pc AS (SELECT product_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'add_to_cart') AS add_to_carts, count(*) FILTER (event_type = 'purchase') AS purchases FROM ev WHERE event_type IN ('view', 'add_to_cart', 'purchase') GROUP BY ALL), tp AS (SELECT *, views + 3 * add_to_carts + 5 * purchases AS score FROM pc ORDER BY score DESC, product_id LIMIT 10)"


@query(f"{COUNTERS} SELECT * FROM pc")
def product_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.product_counters(tables.events(spark, sf_dir))


@query(f"{COUNTERS} SELECT * FROM tp")
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.top_products(product_counters(spark, sf_dir))


@query(f"{COUNTERS}, {PR} SELECT product_id, views, add_to_carts, purchases, score, CASE WHEN length(name) > 28 THEN substr(name, 1, 28) || '…' ELSE name END AS name FROM tp JOIN pr ON id = product_id")
def top_products_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.named(top_products(spark, sf_dir), tables.products(spark, sf_dir))


DAILY = f"{EV}, dc AS (SELECT created_at::DATE AS day, event_type, count(*) AS count FROM ev GROUP BY ALL)"


@query(f"{DAILY} SELECT * FROM dc")
def daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily_counts(tables.events(spark, sf_dir))


@query(f"{DAILY} SELECT * FROM dc ORDER BY day DESC, event_type LIMIT 90")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily_summary(daily_event_counts(spark, sf_dir))


@query(f"{DAILY} SELECT day, " + ", ".join(f"coalesce(sum(count) FILTER (event_type = '{k}'), 0)::BIGINT AS {k}" for k in EVENT_TYPES) + " FROM dc GROUP BY ALL")
def daily_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily_pivot(daily_event_counts(spark, sf_dir))


# Collaborative filtering


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.interactions(tables.events(spark, sf_dir))


@query(f"{IX} SELECT * FROM ix")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"{EV} SELECT user_id, product_id, sum({W1.format('0.0')}) AS weight FROM ev WHERE user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY ALL")
def interactions_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.interactions(tables.events(spark, sf_dir), "zero")


@query(f"{COS} SELECT a, b, round(score, 9) AS score FROM cs")
def item_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.cosine(_pairs(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


@query(f"{COS} SELECT a, b, round(score, 9) AS score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS rank FROM cs QUALIFY rank <= 5")
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar(similar.cosine(_pairs(spark, sf_dir)), 5).select("a", "b", F.round("score", 9).alias("score"), "rank")


@query(f"{IX} SELECT product_id, sum(weight) AS score FROM ix GROUP BY ALL ORDER BY score DESC, product_id LIMIT 10")
def popular_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.popular(_pairs(spark, sf_dir))


@query(f"{REC} SELECT user_id, product_id, score, rank FROM rc")
def recommend_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return similar.recommend(pairs, similar.cosine(pairs)).select("user_id", "product_id", "score", "rank")


@query(f"{REC}, tot AS (SELECT product_id, sum(weight) AS score FROM ix GROUP BY ALL), pop AS (SELECT *, row_number() OVER (ORDER BY score DESC, product_id)::INT AS rank FROM tot QUALIFY rank <= 5) SELECT user_id, product_id, score, rank, 'similar' AS origin FROM rc UNION ALL SELECT c_custkey AS user_id, product_id, score, rank, 'popular' AS origin FROM (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM rc)), pop")
def popular_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    everyone = tables.users(spark, sf_dir).select(F.col("id").alias("user_id")).unionByName(pairs.select("user_id"))
    return similar.with_fallback(everyone, similar.recommend(pairs, similar.cosine(pairs)), pairs)


@query(f"{REC}, {PR} SELECT user_id, product_id, score, rank, name, price FROM rc JOIN pr ON id = product_id")
def recommend_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.enriched(recommend_users(spark, sf_dir), tables.products(spark, sf_dir))


# Sessions and demand


def _session_sql(gap: str, seconds: int) -> str:
    return f"{EV}, g AS (SELECT *, coalesce(epoch(created_at) - epoch(lag(created_at) OVER w) > {seconds}, true)::INT AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM g) SELECT user_id, min(created_at) AS session_start, max(created_at) + INTERVAL '{gap}' AS session_end, count(*) AS event_count, array_to_string(list_sort(list(product_id)), ',') AS products FROM s GROUP BY user_id, n"


def _listed(found: DataFrame) -> DataFrame:
    """Products as text, which every engine shows alike."""
    return found.withColumn("products", F.array_join(F.col("products").cast("array<string>"), ","))


@query(_session_sql("5 minutes", 300))
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(demand.sessions(tables.events(spark, sf_dir)))


@query(_session_sql("6 hours", 21600))
def user_sessions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(demand.sessions(tables.events(spark, sf_dir), "6 hours"))


@query(f"{DEM.format('minute', 'minute')} SELECT * FROM dm")
def demand_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.counts(tables.events(spark, sf_dir))


@query(f"{DEM.format('minute', 'minute')} SELECT * FROM dm WHERE product_id = {PRODUCT} AND bucket_date BETWEEN DATE '{DAY}' - 3 AND DATE '{DAY}'")
def demand_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.series(demand_by_minute(spark, sf_dir), PRODUCT, DAY, 3)


@query(f"{DEM.format('minute', 'minute')} SELECT product_id, bucket_date, hour(bucket)::INT AS event_hour, sum(event_count)::BIGINT AS event_count FROM dm GROUP BY ALL")
def demand_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.hourly(demand_by_minute(spark, sf_dir))


def _z_sql(grain: str, where: str = "") -> str:
    return f"{DEM.format(grain, grain)}, z AS (SELECT product_id, bucket, event_count, count(*) OVER w AS n, coalesce(sum(event_count) OVER w, 0)::BIGINT AS s, coalesce(sum(event_count * event_count) OVER w, 0)::BIGINT AS q FROM dm WINDOW w AS (PARTITION BY product_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), zz AS (SELECT product_id, bucket, event_count, round((n * event_count - s) / sqrt(n * q - s * s), 9) AS z FROM z WHERE n >= 3 AND n * q - s * s > 0) SELECT * FROM zz {where}"


@query(_z_sql("hour"))
def demand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.z_scores(demand.counts(tables.events(spark, sf_dir), "hour")).withColumn("z", F.round("z", 9))


@query(_z_sql("day", "WHERE abs(z) > 2.5"))
def demand_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.anomalies(demand.z_scores(demand.counts(tables.events(spark, sf_dir), "day"))).withColumn("z", F.round("z", 9))


# Streams, drained over a file source in the shared folder


EVENT_FILE = "id string, user_id int, product_id int, event_type string, created_at string"


def _wire(rows: DataFrame) -> DataFrame:
    """Events as they come in files and records."""
    return rows.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("int").alias("user_id"), "product_id", "event_type", F.col("created_at").cast("string").alias("created_at"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str]:
    """Events as a stream of one file a batch, in the order of time, then one that closes all windows, then one that comes too late."""
    root = fresh_path(spark, name)
    rows = _wire(tables.events(spark, sf_dir))
    weeks = ("2024-01-09", "2024-01-16", "2024-01-23")
    for low, high in zip(("", *weeks), (*weeks, "9"), strict=True):
        rows.where((F.col("created_at") >= low) & (F.col("created_at") < high)).coalesce(1).write.mode("append").json(f"{root}/in")
    for row in (("end", 0, -1, "view", "2030-01-01 00:00:00"), ("late", 1, PRODUCT, "view", "2024-01-02 00:00:00")):
        spark.createDataFrame([row], EVENT_FILE).coalesce(1).write.mode("append").json(f"{root}/in")
    return tables.stream_files(spark, f"{root}/in", 1), root


@query(_session_sql("6 hours", 21600).replace("SELECT user_id, min(", "SELECT user_id::INT AS user_id, min("))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "sessions")
    streams.write_sessions(stream, f"{root}/out", f"{root}/checkpoint", once=True, gap="6 hours").awaitTermination()
    out = spark.read.schema("user_id int, session_start timestamp, session_end timestamp, event_count long, products array<int>").option("timestampFormat", streams.TIMES).json(f"{root}/out")
    return _listed(out).withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@query(f"{DEM.format('hour', 'hour')} SELECT product_id, bucket_date, bucket, event_count::INT AS event_count FROM dm")
def stream_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "demand")
    streams.write_demand(stream, f"{root}/out", f"{root}/checkpoint", once=True, grain="1 hour").awaitTermination()
    found = sinks.read_keyed(spark, f"{root}/out", "bucket_date").where("product_id >= 0")
    return found.select("product_id", "bucket_date", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_count")


@query(f"{DEM.format('day', 'day')} SELECT DISTINCT bucket_date, product_id FROM dm")
def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "presence")
    streams.write_demand(stream, f"{root}/out", f"{root}/checkpoint", once=True, grain="1 day", presence=f"{root}/days").awaitTermination()
    return sinks.read_keyed(spark, f"{root}/days", "bucket_date").where("product_id >= 0").select("bucket_date", "product_id")


@query(f"{COUNTERS} SELECT product_id, views + CASE WHEN product_id = {PRODUCT} THEN 1 ELSE 0 END AS views, add_to_carts, purchases FROM pc")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counters have no windows: an event that comes late counts like any other.
    stream, root = _stream(spark, sf_dir, "counters")
    streams.write_counters(stream, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return sinks.read_keyed(spark, f"{root}/out", "slice").where("product_id >= 0").drop("slice")


@query(f"{EV} SELECT strftime(created_at, '%Y-%m-%d') AS dt, count(*) AS events FROM ev GROUP BY ALL")
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "stream-archive")
    streams.write_archive(stream.where("id NOT IN ('end', 'late')"), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return tables.read_archive(spark, f"{root}/out").groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("events"))


@query(_z_sql("hour", "WHERE abs(z) > 2.5").replace("product_id, bucket, event_count, round", "product_id, bucket, event_count::INT AS event_count, round"))
def stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "anomalies")
    streams.write_anomalies(stream, f"{root}/out", f"{root}/checkpoint", once=True, grain="1 hour").awaitTermination()
    out = spark.read.schema("product_id int, bucket timestamp, event_count int, z double").json(f"{root}/out")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).withColumn("z", F.round("z", 9))


@query(f"{EV} SELECT event_type, count(*) AS events, count(created_at) AS timed, max(created_at) AS last FROM ev GROUP BY ALL")
def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Records as the broker would hold them: bytes, with junk between.
    sent = sinks.records(_wire(tables.events(spark, sf_dir))).select(F.col("value").cast("binary").alias("value"))
    junk = spark.createDataFrame([(b"{broken",), (b" ",), (None,)], "value binary")
    back = tables.kafka_events(sent.unionByName(junk))
    return back.groupBy("event_type").agg(F.count("*").alias("events"), F.count("event_time").alias("timed"), F.max("event_time").cast("timestamp_ntz").alias("last"))


# Factorisation and precomputed recommendations


@query(f"{LARGE} SELECT user_id, count(*) AS n FROM lg GROUP BY ALL HAVING n >= 5")
def eligible_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return als.eligible(tables.purchases(spark, sf_dir))


@query(f"{LARGE}, el AS (SELECT user_id FROM lg GROUP BY ALL HAVING count(*) >= 5) SELECT user_id, product_id, weight, CASE WHEN user_id IN (SELECT user_id FROM el) AND ('0x' || substr(md5(user_id || ':' || product_id), 1, 8))::BIGINT % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM lg")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = als.split(tables.purchases(spark, sf_dir))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query()
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (saved(part, name) for part, name in zip(als.split(saved(tables.purchases(spark, sf_dir), "pairs")), ("train", "test"), strict=True))
    return als.precision(als.fit(train), train, test)


@query()
def als_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = saved(tables.purchases(spark, sf_dir), "pairs")
    return als.top(als.fit(pairs), als.eligible(pairs), 10)


WIDE_SQL = ", ".join(f"max(CASE WHEN rank = {i + 1} THEN to_base64(encode(product_id::VARCHAR)) END) AS item_{i:02d}, max(CASE WHEN rank = {i + 1} THEN to_base64(encode(format('{{:.6f}}', score))) END) AS score_{i:02d}" for i in range(5))


@query(f"{REC} SELECT user_id, {WIDE_SQL} FROM rc GROUP BY user_id")
def precomputed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wide_recommendations(recommend_users(spark, sf_dir), 5)


@query(f"{REC} SELECT user_id, (rank - 1)::INT AS rank, product_id::BIGINT AS product_id, score FROM rc WHERE user_id = {PRODUCT}")
def precomputed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "wide")
    precomputed_wide(spark, sf_dir).write.parquet(path)
    return sinks.read_wide(spark.read.parquet(path), PRODUCT, 5)


@query(f"{REC} SELECT user_id AS visitorid, product_id::BIGINT AS itemid, score FROM rc")
def recommendations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "export")
    als.export(spark, recommend_users(spark, sf_dir), path)
    return tables.read_recommendations(spark, path)


@query(f"{EV} SELECT product_id, sum({W1.format('NULL')})::BIGINT AS score FROM ev WHERE event_type IN ('view', 'add_to_cart', 'purchase') AND product_id IS NOT NULL GROUP BY ALL")
def popularity_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "popularity")
    sinks.write_popularity(popularity_batch(spark, sf_dir), path)
    return tables.read_popularity(spark, path)


@query(f"{EV} SELECT user_id, product_id::BIGINT AS product_id, sum({W1.format('0.0')}) AS weight FROM ev GROUP BY ALL")
def clickstream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "clicks")
    kind = F.when(F.col("event_type") == "add_to_cart", "addtocart").when(F.col("event_type") == "purchase", "transaction").otherwise(F.col("event_type"))
    rows = tables.events(spark, sf_dir).select(F.unix_millis(F.col("created_at").cast("timestamp")).alias("timestamp"), F.col("user_id").alias("visitorid"), kind.alias("event"), F.col("product_id").alias("itemid"), F.lit(None).cast("string").alias("transactionid"))
    rows.write.option("header", True).csv(path)
    return als.clickstream_pairs(tables.read_clickstream(spark, path))


# Catalog, users and search


@query(f"{US} SELECT * FROM us WHERE country = 'FRANCE' OR country = 'NATION_5'")
def users_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = tables.users(spark, sf_dir)
    return store.by_country(everyone, "FRANCE").unionByName(store.by_country(everyone, "NATION_5"))


@query(f"{US} SELECT * FROM us ORDER BY id LIMIT 100 OFFSET 20")
def users_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(tables.users(spark, sf_dir), 20)


FLAT = "id, name, category, brand, price, rating_average, rating_count, spot[2] AS lat, spot[1] AS lon, image, asin"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.flat(tables.products(spark, sf_dir))


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "name", "category", "brand", "price", "rating_average", "rating_count", F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon"), F.col("images")[0].alias("image"), "asin", *more)


@query(f"{PR} SELECT {FLAT} FROM pr")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_flat(spark, sf_dir))


@query(f"{PR} SELECT {FLAT} FROM pr ORDER BY id LIMIT 50 OFFSET 10")
def products_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.page(_flat(spark, sf_dir), 10, 50))


@query(f"{PR} SELECT {FLAT} FROM pr WHERE id IN (3, 5, 8, 999999999)")
def products_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(store.by_id(_flat(spark, sf_dir), 3, 5, 8, 999999999))


@query(f"{PR} SELECT {FLAT}, count(*) OVER () AS total FROM pr WHERE price >= 950 AND price <= 1500 AND rating_average >= 2 ORDER BY price, id LIMIT 40")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.search(_flat(spark, sf_dir), sort="price_asc", limit=40, price_min=950.0, price_max=1500.0, rating_min=2.0)
    return _shown(found, "total")


@query(f"{PR}, s AS (SELECT id, price, rating_average, category, brand, count(*) OVER () AS total FROM pr WHERE category = (SELECT min(category) FROM pr)), t AS (SELECT id, price, rating_average, count(*) OVER () AS total FROM pr WHERE brand = (SELECT max(brand) FROM pr)) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{kind}' AS kind, row_number() OVER (ORDER BY {order}, id)::INT AS rank, id, total FROM {rows} QUALIFY rank BETWEEN 4 AND 13)" for kind, order, rows in (("price_asc", "price", "s"), ("price_desc", "price DESC", "s"), ("rating_desc", "rating_average DESC", "t"), ("unknown", "1", "t"))))
def search_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _flat(spark, sf_dir)
    asked = docs.agg(F.min("category").alias("category"), F.max("brand").alias("brand")).first()
    pages = [("price_asc", {"category": asked.category}), ("price_desc", {"category": asked.category}), ("rating_desc", {"brand": asked.brand}), ("unknown", {"brand": asked.brand})]
    out = []
    for kind, terms in pages:
        found = store.search(docs, sort=kind, limit=10, offset=3, **terms)
        order = {"price_asc": [F.asc("price")], "price_desc": [F.desc("price")], "rating_desc": [F.desc("rating_average")]}.get(kind, [])
        # Ranks of a page of ten rows.
        out.append(found.select(F.lit(kind).alias("kind"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "id")) + 3).alias("rank"), "id", "total"))
    return reduce(lambda a, b: a.unionByName(b), out)


KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(40.0) - radians(spot[2])) / 2), 2) + cos(radians(spot[2])) * cos(radians(40.0)) * pow(sin(radians(-75.0 - spot[1]) / 2), 2))))"


@query(f"{PR} SELECT id, round({KM}, 3) AS km FROM pr WHERE {KM} <= 1200")
def search_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flat(spark, sf_dir).where(store.matches(lat=40.0, lon=-75.0, radius_km=1200.0))
    return found.select("id", F.round(store.distance_km(F.col("location.lat"), F.col("location.lon"), 40.0, -75.0), 3).alias("km"))


BM25_SQL = (
    "WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a, "
    + ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df{i}" for i, w in enumerate(("onthe", "that", "with")))
    + " FROM d), sc AS (SELECT id, "
    + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * len(list_filter(t, lambda x: x = '{w}')) * 2.2 / (len(list_filter(t, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / a))" for i, w in enumerate(("onthe", "that", "with")))
    + " AS score FROM d, st) SELECT id, round(score, 4) AS score FROM sc WHERE score > 0"
)


@query(BM25_SQL)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return store.bm25(docs, "text", "That with onthe").withColumn("score", F.round("score", 4))


@query(BM25_SQL)
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    path = fresh_path(spark, "postings")
    store.write_postings(docs, "text", path)
    return store.bm25_of_postings(spark, path, "That with onthe").withColumn("score", F.round("score", 4))


NAME_SQL = (
    f"{PR}, q AS (SELECT lower(split_part(name, ' ', 1)) AS w, split_part(name, ' ', 1) AS whole FROM pr GROUP BY ALL ORDER BY count(*) DESC, whole LIMIT 1), d AS (SELECT id, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM pr), "
    "st AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (list_contains(t, (SELECT w FROM q))) AS df FROM d), "
    "sc AS (SELECT id, 2.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * len(list_filter(t, lambda x: x = w)) * 2.2 / (len(list_filter(t, lambda x: x = w)) + 1.2 * (0.25 + 0.75 * len(t) / a)) AS score FROM d, st, q), "
    "tg AS (SELECT id, 1.0 AS score FROM pr, q WHERE list_contains(tags, whole)), al AS (SELECT id, max(score) AS score FROM (SELECT * FROM sc WHERE score > 0 UNION ALL SELECT * FROM tg) GROUP BY id) "
    f"SELECT {FLAT}, round(score, 6) AS score, count(*) OVER () AS total FROM pr JOIN al USING (id) WHERE price >= 0 ORDER BY al.score DESC, id LIMIT 20"
)


@query(NAME_SQL)
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "part")
    term = docs.select(F.split("p_name", " ")[0].alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").first().w
    return _shown(store.search(_flat(spark, sf_dir), query=term, price_min=0.0), F.round("score", 6).alias("score"), "total")


# Advisors


@query(f"{STATEMENTS} SELECT cycle::INT AS cycle, queryid::BIGINT AS queryid, delta::BIGINT AS delta, kind FROM dl")
def statement_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.deltas(fixtures.statements(spark)).select("cycle", "queryid", "delta", tuning.statement_type(F.col("query")).alias("kind"))


@query(f"{PREDICATES} SELECT queryid::BIGINT AS queryid, \"table\", \"column\", operator FROM pd")
def predicate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.predicates(fixtures.statements(spark).where("cycle = 0"))


TABLES_SQL = "replace(split_part(regexp_extract(query, '(?is)^\\s*(?:select\\b.*?\\bfrom|insert\\s+into|update|delete\\s+from)\\s+([^\\s(,;]+)', 1), '.', 1), '\"', '')"


@query(f"{STATEMENTS} SELECT {TABLES_SQL} AS \"table\", sum(CASE WHEN kind = 'select' THEN delta ELSE 0 END)::BIGINT AS reads, sum(CASE WHEN kind IN ('insert', 'update', 'delete') THEN delta ELSE 0 END)::BIGINT AS writes FROM dl WHERE {TABLES_SQL} <> '' GROUP BY ALL")
def table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.table_load(tuning.deltas(fixtures.statements(spark)))


def _advice_sql() -> str:
    """Three cycles of the advisor, each from the state the one before left."""
    parts = [f"""{PREDICATES}, sx("table", "column", "rows", distinct_ratio) AS (VALUES {fixtures.values(fixtures.STATISTICS)}), fx(cycle, "table", "column") AS (VALUES {fixtures.values(fixtures.FAILURES)}),
z0 AS (SELECT ''::VARCHAR AS "table", ''::VARCHAR AS "column", 0::BIGINT AS calls, 0 AS idle, NULL::VARCHAR AS "index", false AS ranged, NULL::VARCHAR AS action, NULL::VARCHAR AS dropped WHERE false)"""]
    for n in range(1, fixtures.CYCLES):
        parts.append(f"""t{n} AS (SELECT p."table", p."column", sum(d.delta) AS more, bool_or(p.operator <> '=') AS r FROM pd p JOIN dl d USING (queryid) WHERE d.cycle = {n} AND d.delta > 0 GROUP BY ALL),
l{n} AS (SELECT {TABLES_SQL} AS "table", sum(CASE WHEN kind = 'select' THEN delta ELSE 0 END) AS reads, sum(CASE WHEN kind IN ('insert', 'update', 'delete') THEN delta ELSE 0 END) AS writes FROM dl WHERE cycle = {n} GROUP BY ALL),
s{n} AS (SELECT coalesce(o."table", t."table") AS "table", coalesce(o."column", t."column") AS "column", coalesce(calls, 0) + coalesce(more, 0) AS calls, CASE WHEN more IS NOT NULL THEN 0 ELSE coalesce(idle, 0) + 1 END AS idle, "index", coalesce(ranged, false) OR coalesce(r, false) AS ranged FROM z{n - 1} o FULL JOIN t{n} t ON o."table" = t."table" AND o."column" = t."column"),
m{n} AS (SELECT s.*, 'auto_idx_' || CASE WHEN ranged THEN 'btree' ELSE 'hash' END || '_' || s."table" || '_' || s."column" AS wanted, CASE WHEN coalesce(reads, 0) > 0 THEN coalesce(writes, 0) / reads ELSE 0 END AS ratio, sx."rows", sx.distinct_ratio FROM s{n} s LEFT JOIN l{n} l ON l."table" = s."table" LEFT JOIN sx ON sx."table" = s."table" AND sx."column" = s."column"),
x{n} AS (SELECT *, CASE WHEN "index" IS NULL AND calls >= 20 THEN CASE WHEN ratio > 3 THEN 'skip_high_writes' WHEN "rows" < 20 THEN 'skip_table_too_small' WHEN distinct_ratio < 0.05 THEN 'skip_low_cardinality' WHEN wanted = 'auto_idx_hash_users_country' THEN 'adopt_index' ELSE 'create_index' END WHEN "index" IS NOT NULL AND idle >= 3 THEN 'drop_index' END AS action FROM m{n}),
z{n} AS (SELECT x."table", x."column", (CASE WHEN action = 'drop_index' THEN 0 ELSE calls END)::BIGINT AS calls, idle, CASE WHEN action IN ('create_index', 'adopt_index') AND fx.cycle IS NULL THEN wanted WHEN action = 'drop_index' AND fx.cycle IS NULL THEN NULL ELSE "index" END AS "index", ranged, action, CASE WHEN action = 'drop_index' THEN "index" END AS dropped FROM x{n} x LEFT JOIN fx ON fx.cycle = {n} AND fx."table" = x."table" AND fx."column" = x."column")""")
    each = " UNION ALL ".join(f'SELECT {n} AS cycle, "table", "column", calls, idle, "index", ranged, action, dropped FROM z{n}' for n in range(1, fixtures.CYCLES))
    return ",\n".join(parts) + f"\n{each}"


def _cycles(spark: SparkSession) -> list[DataFrame]:
    """The advisor's state after each cycle; some of its actions fail, and are asked for again."""
    polled = tuning.deltas(fixtures.statements(spark))
    state = spark.createDataFrame([], "table string, column string, calls long, idle int, index string, ranged boolean")
    failed, out = fixtures.failures(spark), []
    for n in range(1, fixtures.CYCLES):
        changed = polled.where(F.col("cycle") == n)
        asked = tuning.advance(state, changed, tuning.table_load(changed), fixtures.statistics(spark), fixtures.indexes(spark))
        state = tuning.outcome(asked, failed.where(F.col("cycle") == n))
        path = fresh_path(spark, f"advice-{n}")
        state.write.parquet(path)  # a cycle's state is stored before the next
        state = spark.read.schema(state.schema).parquet(path)
        out.append(state.withColumn("cycle", F.lit(n)))
    return out


ADVICE_SQL = _advice_sql()


@query(ADVICE_SQL)
def index_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), _cycles(spark))


DDL_SQL = "CASE action WHEN 'create_index' THEN 'CREATE INDEX CONCURRENTLY \"auto_idx_' || CASE WHEN ranged THEN 'btree' ELSE 'hash' END || '_' || \"table\" || '_' || \"column\" || '\" ON \"' || \"table\" || '\" USING ' || CASE WHEN ranged THEN 'btree' ELSE 'hash' END || ' (\"' || \"column\" || '\")' WHEN 'drop_index' THEN 'DROP INDEX CONCURRENTLY IF EXISTS \"' || dropped || '\"' END"


@query(f'{ADVICE_SQL.rsplit(chr(10), 1)[0]}, every AS ({ADVICE_SQL.rsplit(chr(10), 1)[1]}) SELECT cycle, "table", "column", {DDL_SQL} AS statement FROM every WHERE (action = \'create_index\' AND "index" IS NOT NULL) OR (action = \'drop_index\' AND "index" IS NULL)')
def index_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = reduce(lambda a, b: a.unionByName(b), _cycles(spark))
    done = told.where("(action = 'create_index' AND index IS NOT NULL) OR (action = 'drop_index' AND index IS NULL)")
    name = F.coalesce("dropped", "index")
    return done.select("cycle", "table", "column", tuning.ddl(F.col("action"), name, F.col("table"), F.col("column"), F.col("ranged")).alias("statement"))


@query(f'{ADVICE_SQL.rsplit(chr(10), 1)[0]}, every AS ({ADVICE_SQL.rsplit(chr(10), 1)[1]}) SELECT TIMESTAMP \'2024-01-01 00:00:00\' + INTERVAL 1 MINUTE * cycle AS ts, \'sql\' AS store, action, "table" || \'.\' || "column" AS target, \'calls \' || calls AS reason, idle FROM every WHERE action IS NOT NULL ORDER BY ts DESC, target LIMIT 50')
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "decisions")
    for state in _cycles(spark):
        at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("cycle"))
        sinks.record_decisions(tuning.decisions(state, at, "sql"), path)
    found = tuning.recent_decisions(spark.read.parquet(path))
    return found.select("ts", "store", "action", "target", "reason", F.get_json_object("metadata", "$.idle").cast("int").alias("idle"))


@query(f'{ADVICE_SQL.rsplit(chr(10), 1)[0]} SELECT DISTINCT "index" FROM z{fixtures.CYCLES - 1} WHERE "index" LIKE \'auto!_idx!_%\' ESCAPE \'!\'')
def managed_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _cycles(spark)[-1].select("index").unionByName(spark.createDataFrame([("users_pkey",), ("autoXidx_no",)], "index string"))
    return tuning.managed(there).distinct()


@query(f"{STATEMENTS} SELECT queryid::BIGINT AS queryid, greatest(calls - coalesce((SELECT b.calls FROM st b WHERE b.cycle = 1 AND b.queryid = dl.queryid), calls), 0)::BIGINT AS delta FROM dl WHERE cycle = 2")
def snapshot_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = fixtures.statements(spark)
    return tuning.snapshot_delta(*(polls.where(F.col("cycle") == n).select("queryid", "calls") for n in (2, 1))).select("queryid", F.col("delta").cast("bigint").alias("delta"))


HOT_SQL = f"{DEM.format('minute', 'minute')}, hc AS (SELECT product_id, sum(CASE WHEN bucket >= TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE AND bucket <= TIMESTAMP '{NOW}' THEN event_count ELSE 0 END)::BIGINT AS recent_volume FROM dm WHERE bucket_date BETWEEN DATE '{DAY}' - 3 AND DATE '{DAY}' GROUP BY ALL), hh AS (SELECT *, CASE WHEN recent_volume >= 5 THEN 'hot' ELSE 'cold' END AS granularity FROM hc)"


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.hot_or_cold(demand_by_minute(spark, sf_dir), NOW, hot=5, lookback=1440)


@query(f"{HOT_SQL} SELECT * FROM hh")
def hot_cold_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir)


@query(f"{HOT_SQL} SELECT * FROM hh WHERE (product_id % 3 = 0) OR (product_id % 3 = 1 AND granularity = 'hot') OR (product_id % 3 = 2 AND granularity = 'cold')")
def strategy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _hot(spark, sf_dir)
    stored = now.where("product_id % 3 <> 0").select("product_id", F.when(F.col("product_id") % 3 == 1, "cold").otherwise("hot").alias("granularity"))
    return tuning.changes(now, stored).drop("was")


@query(f"{HOT_SQL} SELECT count(*) FILTER (granularity = 'hot') AS hot, count(*) FILTER (granularity = 'cold') AS cold FROM hh")
def tuning_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hot(spark, sf_dir).agg(F.count_if(F.col("granularity") == "hot").alias("hot"), F.count_if(F.col("granularity") == "cold").alias("cold"))


BURST_SQL = f'{EV}, h AS (SELECT event_type AS source, date_trunc(\'hour\', created_at) AS "at", count(*) AS c FROM ev GROUP BY ALL), t AS (SELECT source, "at", sum(c) OVER (PARTITION BY source ORDER BY "at")::BIGINT AS total FROM h), d AS (SELECT *, coalesce(greatest(total - lag(total) OVER (PARTITION BY source ORDER BY "at"), 0), 0)::BIGINT AS delta FROM t), m AS (SELECT *, CASE WHEN delta >= 5 THEN \'burst\' ELSE \'normal\' END AS mode FROM d) SELECT source, "at", total, delta, mode, CASE WHEN mode = \'burst\' THEN 5 ELSE 1 END AS refresh_seconds FROM m QUALIFY mode <> coalesce(lag(mode) OVER (PARTITION BY source ORDER BY "at"), \'normal\')'


@query(BURST_SQL)
def burst_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = tables.events(spark, sf_dir).groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", F.col("created_at")).cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy("source").orderBy("at"))
    return tuning.bursts(hours.select("source", "at", total.alias("total")), 5)


@query(f"{EV}, d AS (SELECT user_id AS key, created_at::DATE AS cycle, bool_or(event_type = 'purchase') AS touched FROM ev GROUP BY ALL), i AS (SELECT *, sum(touched::INT) OVER (PARTITION BY key ORDER BY cycle) AS n FROM d) SELECT key, cycle, touched, (row_number() OVER (PARTITION BY key, n ORDER BY cycle) - CASE WHEN n > 0 THEN 1 ELSE 0 END)::INT AS idle FROM i")
def idle_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = tables.events(spark, sf_dir).groupBy(F.col("user_id").alias("key"), F.to_date("created_at").alias("cycle")).agg(F.bool_or(F.col("event_type") == "purchase").alias("touched"))
    return tuning.idle_cycles(days)


@query(f"{HOT_SQL} SELECT bucket AS ts, 'demand' AS store, 'seen' AS action, product_id::VARCHAR AS target, 'count ' || event_count AS reason FROM dm ORDER BY ts DESC, target LIMIT 50")
def recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_by_minute(spark, sf_dir)
    log = rows.select(F.col("bucket").alias("ts"), F.lit("demand").alias("store"), F.lit("seen").alias("action"), F.col("product_id").cast("string").alias("target"), F.concat(F.lit("count "), "event_count").alias("reason"))
    return tuning.recent_decisions(log)


# Catalog cleaning

CLEAN_SQL = "SELECT substr(p_name, 1, 200) AS name, 'home garden' AS category, round(p_retailprice, 2) AS price, substr(p_name || ' ' || p_type, 1, 500) AS description, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_type ELSE 'Unknown' END AS brand, 'http://img/' || p_partkey AS image, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size / 10.0 END, 0.0)::DOUBLE AS rating_average, p_size::BIGINT AS rating_count, p_partkey::VARCHAR AS asin FROM part WHERE length(p_name) > 5 AND p_size % 10 <> 3 AND p_size % 9 <> 4 AND p_retailprice > 0 AND p_retailprice <= 2000"


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    size = F.col("p_size")
    brand = F.when(size % 4 == 1, F.to_json(F.struct(F.col("p_type").alias("Brand")))).otherwise("{}")
    return part.select(
        F.col("p_name").alias("title"), F.when(size % 10 == 3, F.lit("None")).otherwise(F.col("p_retailprice").cast("string")).alias("price"),
        F.when(size % 4 == 0, F.col("p_brand")).otherwise("").alias("store"), brand.alias("details"), F.array(F.concat_ws(" ", "p_name", "p_type")).alias("description"),
        F.struct(F.when(size % 9 == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://img/"), "p_partkey"))).alias("large")).alias("images"),
        F.when(size % 7 != 0, size / 10.0).cast("double").alias("average_rating"), size.cast("bigint").alias("rating_number"), F.col("p_partkey").cast("string").alias("parent_asin"),
    )


@query(CLEAN_SQL.replace("SELECT", "WITH c AS (SELECT", 1) + ") SELECT * FROM c")
def catalog_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(_metadata(spark, sf_dir), "Home_Garden")


@query(CLEAN_SQL.replace("SELECT", "WITH c AS (SELECT", 1) + ") SELECT * FROM c")
def catalog_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, path = fresh_path(spark, "metadata"), fresh_path(spark, "catalog")
    _metadata(spark, sf_dir).write.parquet(raw)
    cleaned = cleaning.clean(tables.read_metadata(spark, raw), "Home_Garden")
    sinks.write_catalog(cleaned, path)
    return spark.read.schema(cleaned.schema).json(path)


@query(f"{PR} SELECT {FLAT} FROM pr")
def products_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Files that hold one JSON array each, of a thousand products.
    path = fresh_path(spark, "array")
    every = tables.products(spark, sf_dir)
    dealt = every.groupBy((F.col("id") / 1000).cast("long").alias("file")).agg(F.to_json(F.collect_list(F.struct(*every.columns))).alias("value"))
    dealt.write.partitionBy("file").text(path)
    return _shown(store.flat(tables.read_products(spark, path).withColumn("id", F.col("id").cast("bigint"))))


@query(f"{US}, m AS (SELECT max(id) AS m FROM us), nw AS (SELECT (m + row_number() OVER (ORDER BY s_name))::BIGINT AS id, s_name AS username, lower(replace(s_name, '#', '.')) || '@example.com' AS email, '' AS country FROM supplier, m) SELECT * FROM us UNION ALL SELECT * FROM nw")
def users_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, there = fresh_path(spark, "users"), tables.users(spark, sf_dir)
    there.write.parquet(path)
    new = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("username"), F.concat(F.lower(F.translate("s_name", "#", ".")), F.lit("@example.com")).alias("email"), F.lit("").alias("country"))
    sinks.append(spark, path, new, there, "username")
    return spark.read.schema(there.schema).parquet(path)


@query(f"{PR} SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id)::INT AS rank FROM pr QUALIFY rank <= 75")
def catalog_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.first_of_each(tables.products(spark, sf_dir)).select("id", "category", "rank")


@query("WITH m AS (SELECT max(p_partkey) AS m FROM part) SELECT s_suppkey, (m + row_number() OVER (ORDER BY s_suppkey))::BIGINT AS id FROM supplier, m")
def id_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_ids(tables.table(spark, sf_dir, "supplier").select("s_suppkey"), tables.products(spark, sf_dir), "s_suppkey")
