"""Progress of streams as rows, and counts of what a write saw."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.operators.events import validate
from millrace.sources import files

PROGRESS = "run string, name string, batch long, rows_in long, rows_per_second double, milliseconds long, watermark string, state_rows long, ended string"


class ProgressRows(StreamingQueryListener):
    """Writes each batch's progress as one small file of one row, named by run and batch, so that a repeated report replaces itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """A start is no progress."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = json.loads(event.progress.json)
        if told["numInputRows"] or not files.exists(self.spark, f"{self.path}/{told['runId']}-{told['batchId']}.json"):
            row = {"run": told["runId"], "name": told.get("name"), "batch": told["batchId"], "rows_in": told["numInputRows"], "rows_per_second": told.get("processedRowsPerSecond"), "milliseconds": told.get("batchDuration"), "watermark": told.get("eventTime", {}).get("watermark"), "state_rows": sum(s["numRowsTotal"] for s in told.get("stateOperators", []))}
            files.write_text(self.spark, f"{self.path}/{told['runId']}-{told['batchId']}.json", json.dumps(row) + "\n")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """A trigger without data is no progress."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        row = {"run": str(event.runId), "ended": event.exception or "finished"}
        files.write_text(self.spark, f"{self.path}/{event.runId}-end.json", json.dumps(row) + "\n")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A row for each batch, and one with ``ended`` for each query that ended: ``finished``, or its error."""
    return spark.read.schema(PROGRESS).json(path)


def write_observed(events: DataFrame, path: str) -> dict[str, int]:
    """Writes valid events and gives the counts of all: ``events``, ``valid`` and each reason of refusal, taken in the same pass."""
    seen = Observation("ingestion")
    judged = validate(events)
    reasons = ("missing", "unknown_type")
    counted = judged.observe(seen, F.count("*").alias("events"), F.count_if("valid").alias("valid"), *(F.count_if(F.col("reason") == r).alias(r) for r in reasons))
    counted.where("valid").drop("reason", "valid").write.mode("overwrite").parquet(path)
    return dict(seen.get)
