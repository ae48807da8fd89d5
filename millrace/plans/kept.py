"""Queries over tables and indexes that are kept up to date by batches and streams, each beside its SQL."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import similar, store
from millrace.operators.inverted import Index
from millrace.operators.products import Products
from millrace.operators.tiers import Tiers
from millrace.plans.catalog import COS, COUNTERS, DEM, EV, FLAT, PR, PRODUCT, REC, _pairs, _shown, _stream, _wire, demand_by_minute, product_counters
from millrace.sources import created, files, presence, sinks, strict, tables
from millrace.sources.keyvalue import KeyValue
from millrace.sources.rowgroups import sample_groups
from millrace.sources.shared import fresh_path
from millrace.streaming import bursts, checked, progress, similarity
from millrace.streaming import queries as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {sql}"
        return f

    return put


# Search that follows the catalog

WORDS_SQL = "list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _bm25_sql(rows: str, words: list[str], boost: float) -> str:
    """Scores of the names of ``rows`` (id, name) for a query's words."""
    dfs = ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df{i}" for i, w in enumerate(words))
    gain = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * len(list_filter(t, lambda x: x = '{w}')) * 2.2 / (len(list_filter(t, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / a))" for i, w in enumerate(words))
    return f"d AS (SELECT id, {WORDS_SQL} AS t FROM {rows}), st AS (SELECT count(*) AS n, avg(len(t)) AS a, {dfs} FROM d), sc AS (SELECT id, {boost} * ({gain}) AS score FROM d, st)"


@query(f"{PR}, fin AS (SELECT id, CASE WHEN p_size % 22 = 0 THEN 'restored ' || name WHEN p_size % 7 = 0 THEN name || ' refreshed' ELSE name END AS name FROM pr JOIN part ON p_partkey = id WHERE p_size % 11 <> 0 OR p_size % 22 = 0), {_bm25_sql('fin', ['refreshed', 'restored'], 2.0)} SELECT id, round(score, 6) AS score FROM sc WHERE score > 0")
def index_write_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Insertions, changed names, deletions, and some of the deleted ones again under another name.
    index = Index(spark, fresh_path(spark, "index"), list(store.FIELDS), least=100, fan=3)
    rows = tables.products(spark, sf_dir).join(tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    batches = [
        rows.withColumn("deleted", F.lit(False)),
        rows.where("p_size % 7 = 0").withColumn("name", F.concat("name", F.lit(" refreshed"))).withColumn("deleted", F.lit(False)),
        rows.where("p_size % 11 = 0").withColumn("deleted", F.lit(True)),
        rows.where("p_size % 22 = 0").withColumn("name", F.concat(F.lit("restored "), "name")).withColumn("deleted", F.lit(False)),
    ]
    for n, batch in enumerate(batches):
        index.apply(batch, n)
    return index.scores("Refreshed restored", store.FIELDS).withColumn("score", F.round("score", 6))


@query(f"{PR}, m AS (SELECT max(id) AS m FROM pr), nw AS (SELECT (m + row_number() OVER (ORDER BY s_name))::BIGINT AS id, 'Stock of ' || s_name AS name, 'stock' AS category, '' AS brand, s_acctbal AS price, 0.0::DOUBLE AS rating_average, 0::INT AS rating_count, NULL::DOUBLE[] AS spot, NULL::VARCHAR AS image, s_name AS asin FROM supplier, m), al AS (SELECT id, name, category, brand, price, rating_average, rating_count, spot, image, asin FROM pr UNION ALL SELECT * FROM nw), {_bm25_sql('al', ['stock'], 2.0)} SELECT {FLAT}, round(score, 6) AS score, count(*) OVER () AS total FROM al JOIN sc USING (id) WHERE score > 0 AND price >= 0 ORDER BY sc.score DESC, id LIMIT 40")
def search_follows_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Products are created under new ids and found by the next search.
    shop = Products(spark, fresh_path(spark, "shop"))
    there = tables.products(spark, sf_dir)
    shop.put(there, 0)
    new = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Stock of "), "s_name").alias("name"), F.lit("stock").alias("category"), F.col("s_acctbal").alias("price"), F.lit("").alias("description"), F.array(F.lit("new")).alias("tags"), F.struct(F.lit(0.0).alias("average"), F.lit(0).alias("count")).alias("rating"), F.col("s_name").alias("asin"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema if f.name not in new.columns and f.name != "id"]
    shop.create(new.select("*", *missing), "name", 1)
    return _shown(shop.search("Stock", limit=40, price_min=0.0), F.round("score", 6).alias("score"), "total")


# Lookups by key and created tables


@query(f"{REC} SELECT user_id, (rank - 1)::INT AS rank, product_id::BIGINT AS product_id, score FROM rc WHERE user_id IN (1, 7, 14, 15) AND (user_id % 7 <> 0 OR rank <= 2)")
def precomputed_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every user's wide row, then another put for some of them; users are got by key.
    found = similar.recommend(_pairs(spark, sf_dir), similar.cosine(_pairs(spark, sf_dir)))
    table = KeyValue(spark, fresh_path(spark, "wide-rows"), "user_id")
    table.put(sinks.wide_recommendations(found, 5), 0)
    table.put(sinks.wide_recommendations(found.where("user_id % 7 = 0 AND rank <= 2"), 5), 1)
    return sinks.unpacked(table.get(1, 7, 14, 15, 999_999_999), 5)


@query(f"{COUNTERS}, {PR} SELECT product_id, name, views, add_to_carts, purchases FROM pc JOIN pr ON id = product_id")
def bucketed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both tables are bucketed by product: the join moves no rows.
    database, root = f"millrace_{uuid.uuid4().hex}", fresh_path(spark, "created")
    created.ensure(spark, database, root)
    created.insert(product_counters(spark, sf_dir), database, created.COUNTERS)
    created.ensure(spark, database, root)
    created.insert(tables.products(spark, sf_dir).select(F.col("id").cast("int").alias("product_id"), "name", "price"), database, created.NAMES)
    left, right = (spark.read.table(f"{database}.{t.name}") for t in (created.COUNTERS, created.NAMES))
    return left.join(right.hint("merge"), "product_id").select("product_id", "name", "views", "add_to_carts", "purchases")


# Bad records

REASON_SQL = "CASE WHEN event_type = 'error' THEN 'not_json' WHEN user_id IS NULL OR product_id IS NULL OR event_type IS NULL THEN 'missing' WHEN event_type NOT IN ('view', 'add_to_cart', 'purchase') THEN 'unknown_type' END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text; errors lack their last character."""
    rows = _wire(tables.events(spark, sf_dir))
    text = F.to_json(F.struct(*rows.columns))
    return rows.select(F.when(F.col("event_type") == "error", F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("value"))


@query(f"{EV}, r AS (SELECT {REASON_SQL} AS reason FROM ev) SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'rejected' END AS outcome, reason, count(*) AS records FROM r GROUP BY ALL")
def stream_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "rejected")
    _lines(spark, sf_dir).write.text(f"{root}/in")
    checked.write_checked(checked.stream_records(spark, f"{root}/in", 2), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(checked.OUTCOMES).parquet(f"{root}/out").groupBy("outcome", "reason").agg(F.count("*").alias("records"))


@query(f"{EV}, r AS (SELECT {REASON_SQL} AS reason FROM ev) SELECT 'mark' AS policy, reason, count(*) AS records FROM r GROUP BY ALL UNION ALL SELECT 'skip', NULL, count(*) FROM r WHERE reason IS NULL UNION ALL SELECT 'fail', NULL, count(*) FROM r WHERE reason IS NULL")
def json_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    good = strict.parse(lines, "mark").where("reason IS NULL").select("value")
    each = [("mark", strict.parse(lines, "mark").select("reason")), *((p, strict.parse(rows, p).select(F.lit(None).cast("string").alias("reason"))) for p, rows in (("skip", lines), ("fail", good)))]
    counted = [rows.groupBy("reason").agg(F.count("*").alias("records")).select(F.lit(p).alias("policy"), "reason", "records") for p, rows in each]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# Streams that keep state and tables

SILENT_SQL = f"""{EV}, h AS (SELECT event_type AS source, date_trunc('hour', created_at) AS "at", count(*) AS c FROM ev GROUP BY ALL),
t AS (SELECT source, "at", sum(c) OVER w AS total, CASE WHEN lag(c) OVER w IS NULL THEN 0 ELSE c END AS delta, lead("at") OVER w AS next FROM h WINDOW w AS (PARTITION BY source ORDER BY "at")),
m AS (SELECT source, "at", total, delta, CASE WHEN delta >= 5 THEN 'burst' ELSE 'normal' END AS mode, next FROM t),
u AS (SELECT source, "at", total, delta, mode FROM m UNION ALL SELECT source, "at" + INTERVAL 90 MINUTE, total, 0, 'normal' FROM m WHERE mode = 'burst' AND (next IS NULL OR next > "at" + INTERVAL 90 MINUTE))
SELECT source, "at", total::BIGINT AS total, delta::BIGINT AS delta, mode, CASE WHEN mode = 'burst' THEN 5 ELSE 1 END AS refresh_seconds FROM u QUALIFY mode <> coalesce(lag(mode) OVER (PARTITION BY source ORDER BY "at"), 'normal')"""


@query(SILENT_SQL)
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Bursts of the batch form, each ended by a timer where its source fell silent.
    stream, root = _stream(spark, sf_dir, "bursts")
    bursts.write_bursts(stream, f"{root}/out", f"{root}/checkpoint", once=True, threshold=5).awaitTermination()
    out = spark.read.schema(bursts.SCHEMA).option("timestampFormat", streams.TIMES).json(f"{root}/out")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"{COS} SELECT a, b, round(score, 9) AS score FROM cs")
def stream_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, root = _stream(spark, sf_dir, "similarity")
    similarity.write_similarity(stream.where("id NOT IN ('end', 'late')"), f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return similarity.Similarity(spark, f"{root}/out").cosine().withColumn("score", F.round("score", 9))


@query(f"{DEM.format('minute', 'minute')} SELECT product_id, bucket_date, hour(bucket)::INT AS event_hour, sum(event_count)::BIGINT AS event_count FROM dm GROUP BY ALL")
def tiered_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A roll for each week, whose products turn hot and cold; the reader unites what stands in minutes and in hours.
    tiers = Tiers(spark, fresh_path(spark, "tiers"), hot=5, lookback=2880)
    minutes = demand_by_minute(spark, sf_dir)
    ends = ("2024-01-08", "2024-01-15", "2024-01-22", "2030-01-01")
    for n, (low, high) in enumerate(zip(("1970-01-01", *ends[:-1]), ends, strict=True)):
        week = minutes.where((F.col("bucket_date") >= F.lit(low).cast("date")) & (F.col("bucket_date") < F.lit(high).cast("date")))
        tiers.roll(week, f"{high} 00:00:00", n)
    return tiers.by_hour()


@query("WITH w AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 0 WHEN ts < TIMESTAMP '2024-01-16' THEN 1 WHEN ts < TIMESTAMP '2024-01-23' THEN 2 ELSE 3 END AS batch FROM events UNION ALL SELECT 4 UNION ALL SELECT 5) SELECT batch::BIGINT AS batch, count(*) AS rows_in FROM w GROUP BY batch")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Progress as the listener told it: the rows of each batch.
    stream, root = _stream(spark, sf_dir, "progress")
    listener = progress.ProgressRows(spark, f"{root}/progress")
    spark.streams.addListener(listener)
    try:
        started = streams.write_archive(stream, f"{root}/out", f"{root}/checkpoint", once=True)
        started.awaitTermination()
        for _ in range(300):  # reports come by a bus of their own
            if files.exists(spark, f"{root}/progress/{started.runId}-end.json"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = progress.read_progress(spark, f"{root}/progress").where((F.col("run") == str(started.runId)) & (F.col("rows_in") > 0))
    return told.select("batch", "rows_in")


@query(f"{EV} SELECT count(*) AS events, count(*) FILTER (event_type IN ('view', 'add_to_cart', 'purchase') AND user_id IS NOT NULL AND product_id IS NOT NULL) AS valid, count(*) FILTER (user_id IS NULL OR product_id IS NULL OR event_type IS NULL) AS missing, count(*) FILTER (event_type NOT IN ('view', 'add_to_cart', 'purchase') AND user_id IS NOT NULL AND product_id IS NOT NULL) AS unknown_type FROM ev")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts come from the pass that writes the valid events.
    told = progress.write_observed(tables.events(spark, sf_dir), fresh_path(spark, "valid"))
    return spark.createDataFrame([tuple(told[k] for k in ("events", "valid", "missing", "unknown_type"))], "events long, valid long, missing long, unknown_type long")


@query(f"{DEM.format('hour', 'hour')} SELECT product_id, bucket_date, bucket, event_count::INT AS event_count FROM dm WHERE product_id = {PRODUCT}")
def demand_by_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stream keeps demand and presence; the days to read come from the presence table while the query runs.
    stream, root = _stream(spark, sf_dir, "by-presence")
    streams.write_demand(stream, f"{root}/out", f"{root}/checkpoint", once=True, grain="1 hour", presence=f"{root}/days").awaitTermination()
    kept, seen = (sinks.read_keyed(spark, f"{root}/{name}", "bucket_date") for name in ("out", "days"))
    found = presence.minutes_of(kept, seen, F.col("product_id") == PRODUCT)
    return found.select("product_id", "bucket_date", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_count")


@query("WITH x AS (SELECT p_brand, count(*) AS products, sum(p_size)::BIGINT AS size FROM part GROUP BY ALL) SELECT * FROM x")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All row groups of the table, a task for each; tests draw some of them.
    rows = sample_groups(spark, f"{sf_dir}/part.parquet", "p_brand", "p_size")
    return rows.groupBy("p_brand").agg(F.count("*").alias("products"), F.sum("p_size").alias("size"))
