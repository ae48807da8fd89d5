"""Command-line jobs: ``spark-submit -m millrace.jobs NAME --option value``; each is a thin call of the engine.

A job that fails ends with an error; streams go on from their checkpoint when they are started again.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import als, cleaning, events, similar
from millrace.sources import sinks, tables
from millrace.streaming import queries as streams


def _stream(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    """Events from a folder of JSON files or, if brokers are given, from the topic."""
    return tables.stream_kafka(spark, given.brokers, given.topic) if given.brokers else tables.stream_files(spark, given.source)


def archive(spark: SparkSession, given: argparse.Namespace) -> None:
    """Keeps the archive by day."""
    streams.write_archive(_stream(spark, given), given.target, given.checkpoint, given.once).awaitTermination()


def sessions(spark: SparkSession, given: argparse.Namespace) -> None:
    """Appends closed sessions."""
    streams.write_sessions(_stream(spark, given), given.target, given.checkpoint, given.once).awaitTermination()


def demand(spark: SparkSession, given: argparse.Namespace) -> None:
    """Keeps demand by minute and the products of each day."""
    streams.write_demand(_stream(spark, given), f"{given.target}/minutes", given.checkpoint, given.once, presence=f"{given.target}/days").awaitTermination()


def anomalies(spark: SparkSession, given: argparse.Namespace) -> None:
    """Appends counts beyond the threshold."""
    streams.write_anomalies(_stream(spark, given), given.target, given.checkpoint, given.once).awaitTermination()


def counters(spark: SparkSession, given: argparse.Namespace) -> None:
    """Keeps views, additions and purchases of each product."""
    streams.write_counters(_stream(spark, given), given.target, given.checkpoint, given.once).awaitTermination()


def popularity(spark: SparkSession, given: argparse.Namespace) -> None:
    """Scores of products from the archive, as tab-separated text."""
    sinks.write_popularity(events.popularity(tables.read_archive(spark, given.source)), given.target)


def similar_items(spark: SparkSession, given: argparse.Namespace) -> None:
    """Recommendations of each user from the archive, as wide rows."""
    pairs = similar.interactions(tables.read_archive(spark, given.source))
    found = similar.recommend(pairs, similar.cosine(pairs), given.count)
    sinks.wide_recommendations(found, given.count).write.mode("overwrite").parquet(given.target)


def factorise(spark: SparkSession, given: argparse.Namespace) -> None:
    """Trains on a clickstream file, stores the model and exports recommendations of eligible users."""
    pairs = als.clickstream_pairs(tables.read_clickstream(spark, given.source))
    model = als.fit(pairs)
    als.save(model, f"{given.target}/model")
    als.export(spark, als.top(model, als.eligible(pairs), given.count), f"{given.target}/recommendations")


def catalog(spark: SparkSession, given: argparse.Namespace) -> None:
    """Cleans product metadata of a category and dumps the catalog."""
    sinks.write_catalog(cleaning.clean(tables.read_metadata(spark, given.source), given.category), given.target)


JOBS: dict[str, Callable[[SparkSession, argparse.Namespace], None]] = {
    f.__name__: f for f in (archive, sessions, demand, anomalies, counters, popularity, similar_items, factorise, catalog)
}


def main(arguments: list[str] | None = None) -> None:
    """Runs one job in a session of its own."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--source", default="")
    parser.add_argument("--brokers", default="")
    parser.add_argument("--topic", default="events")
    parser.add_argument("--target", required=True)
    parser.add_argument("--checkpoint", default="")
    parser.add_argument("--category", default="")
    parser.add_argument("--count", type=int, default=10)
    parser.add_argument("--once", action="store_true")
    given = parser.parse_args(arguments)
    JOBS[given.job](SparkSession.builder.appName(f"millrace-{given.job}").getOrCreate(), given)


if __name__ == "__main__":
    main()
