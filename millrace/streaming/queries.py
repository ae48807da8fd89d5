"""Structured Streaming forms of sessions, demand, anomalies and the archive.

They share their aggregates with the batch forms in ``operators.demand`` and read events with an ``event_time`` column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.workers import importable
from millrace.operators.demand import LEAST, THRESHOLD, sessions
from millrace.operators.events import product_counters
from millrace.sources import sinks

#: How late events may be, what ends a session, and how often batches run.
SESSION_WATERMARK, SESSION_GAP, DEMAND_WATERMARK, TRIGGER = "10 minutes", "5 minutes", "2 minutes", "30 seconds"

#: Times in files keep their microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _started(writer, once: bool, trigger: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)


def closed_sessions(events: DataFrame, gap: str = SESSION_GAP, watermark: str = SESSION_WATERMARK) -> DataFrame:
    """Sessions, each given once the watermark has passed its end."""
    return sessions(events.withWatermark("event_time", watermark), gap, "event_time")


def write_sessions(events: DataFrame, path: str, checkpoint: str, once: bool = False, **kinds: str) -> StreamingQuery:
    """Appends closed sessions as JSON files."""
    writer = closed_sessions(events, **kinds).writeStream.outputMode("append").format("json").option("timestampFormat", TIMES).option("path", path).option("checkpointLocation", checkpoint)
    return _started(writer, once, TRIGGER).start()


def demand(events: DataFrame, grain: str = "1 minute", watermark: str = DEMAND_WATERMARK) -> DataFrame:
    """Counts by product and tumbling window."""
    grouped = events.withWatermark("event_time", watermark).groupBy(F.window("event_time", grain).alias("w"), "product_id").agg(F.count("*").cast("int").alias("event_count"))
    return grouped.select("product_id", F.to_date("w.start").alias("bucket_date"), F.col("w.start").alias("bucket"), "event_count")


def write_demand(events: DataFrame, path: str, checkpoint: str, once: bool = False, grain: str = "1 minute", presence: str | None = None) -> StreamingQuery:
    """Keeps a demand table by day: each changed window replaces its row, so that repeated batches leave the same table.

    presence: a table of the products of each day, kept beside it.
    """

    def put(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            sinks.upsert(batch.sparkSession, path, batch, ["product_id", "bucket"], "bucket_date", n)
            if presence:
                seen = batch.select("bucket_date", "product_id").distinct()
                sinks.upsert(batch.sparkSession, presence, seen, ["bucket_date", "product_id"], "bucket_date", n)

    writer = demand(events, grain).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return _started(writer, once, TRIGGER).start()


def write_counters(events: DataFrame, path: str, checkpoint: str, once: bool = False, slices: int = 16) -> StreamingQuery:
    """Keeps views, additions and purchases of each product as events arrive; the table is partitioned by ``slice`` of the id."""
    sliced = F.pmod(F.coalesce("product_id", F.lit(0)), F.lit(slices)).alias("slice")

    def put(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            sinks.upsert(batch.sparkSession, path, batch.select("*", sliced), ["product_id"], "slice", n)

    writer = product_counters(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return _started(writer, once, TRIGGER).start()


class RunningScore(StatefulProcessor):
    """A product's counts so far as (n, sum, square sum); each closed window is judged against those before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, s long, q long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows)).sort_values("bucket")
        n, s, q = self.totals.get() if self.totals.exists() else (0, 0, 0)
        out = []
        for bucket, c in zip(seen["bucket"], seen["event_count"].astype(int), strict=True):
            spread = n * q - s * s
            if n >= LEAST and spread > 0:
                out.append((key[0], bucket, c, (n * c - s) / spread**0.5))
            n, s, q = n + 1, s + c, q + c * c
        self.totals.update((int(n), int(s), int(q)))
        yield pd.DataFrame(out, columns=["product_id", "bucket", "event_count", "z"])

    def close(self) -> None:
        """Nothing to close."""


_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scores(events: DataFrame, grain: str = "1 minute", watermark: str = DEMAND_WATERMARK) -> DataFrame:
    """z-scores of closed windows, with checkpointed state for each product. The query must start with the RocksDB state store."""
    importable(events.sparkSession)
    closed = demand(events, grain, watermark)
    return closed.groupBy("product_id").transformWithStateInPandas(RunningScore(), "product_id int, bucket timestamp, event_count int, z double", "Append", "None")


def write_anomalies(events: DataFrame, path: str, checkpoint: str, once: bool = False, grain: str = "1 minute", threshold: float = THRESHOLD) -> StreamingQuery:
    """Appends scores beyond the threshold as JSON files."""
    found = scores(events, grain).where(F.abs("z") > threshold)
    writer = found.writeStream.outputMode("append").format("json").option("timestampFormat", TIMES).option("path", path).option("checkpointLocation", checkpoint)
    # A query keeps the settings it starts with; the session's own are put back.
    conf = events.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return _started(writer, once, TRIGGER).start()
    finally:
        conf.set(_STORE, before)


def write_archive(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps the day-partitioned archive, exactly once through the file sink's log."""
    day = F.date_format(F.coalesce(F.to_date(F.try_to_timestamp("created_at")), F.current_date()), "yyyy-MM-dd")
    dated = events.withColumn("dt", day).drop("event_time")
    writer = dated.writeStream.format("json").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
    return _started(writer, once, TRIGGER).start()


def run_all(spark: SparkSession, events: DataFrame, root: str) -> None:
    """Sessions and anomalies side by side until one ends."""
    write_sessions(events, f"{root}/sessions", f"{root}/checkpoints/sessions")
    write_anomalies(events, f"{root}/anomalies", f"{root}/checkpoints/anomalies")
    spark.streams.awaitAnyTermination()


def progress(query: StreamingQuery) -> dict:
    """The latest progress of a query, as plain values."""
    return json.loads(query.lastProgress.json) if query.lastProgress else {}
