"""Demand by day, read by way of the presence table: only the days on which a product was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minutes_of(demand: DataFrame, presence: DataFrame, wanted: Column) -> DataFrame:
    """The counts of some products. demand: partitioned by ``bucket_date``; presence: (bucket_date, product_id); wanted: a condition on ``product_id``.

    The days come from the presence table while the query runs (dynamic partition pruning), so that folders of other days are not read.
    """
    # Days are few (a row for each), however many products are wanted: Spark broadcasts them if their size allows, and prunes either way where it pays.
    days = presence.where(wanted).select("bucket_date").distinct()
    return demand.where(wanted).join(days, "bucket_date", "left_semi")


def partitions_read(frame: DataFrame) -> int:
    """Runs a frame and tells how many partitions its file scans read."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan

    def scans(p) -> list:
        if p.nodeName().endswith("QueryStage"):
            return scans(p.plan())
        below = p.children()
        return [x for i in range(below.size()) for x in scans(below.apply(i))] + ([p] if p.nodeName().startswith("Scan") and p.metrics().contains("numPartitions") else [])

    return sum(p.metrics().apply("numPartitions").value() for p in scans(plan))
