"""A consumer that goes on after bad records: good events and rejected records, written together and once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.schemas import EVENT
from millrace.sources.strict import checked
from millrace.streaming.queries import TRIGGER, _started

OUTCOMES = f"{EVENT.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, reason string, place string, value string, outcome string"


def stream_records(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Lines of text files as records, with the file as their ``place``."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path).select("value", F.col("_metadata.file_path").alias("place"))


def kafka_places(raw: DataFrame) -> DataFrame:
    """Records of a topic, with topic, partition and offset as their ``place``."""
    return raw.select(F.col("value").cast("string").alias("value"), F.concat_ws(":", "topic", "partition", "offset").alias("place"))


def outcomes(records: DataFrame) -> DataFrame:
    """Each record once: a good one as its event, a rejected one as its text with the reason."""
    found = checked(records)
    good = F.col("reason").isNull()
    return found.withColumn("value", F.when(~good, F.col("value"))).withColumn("outcome", F.when(good, "good").otherwise("rejected")).select(*EVENT.names, "reason", "place", "value", "outcome")


def write_checked(records: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes both outcomes in one pass over a batch, in folders of their own, exactly once by the file sink's log."""
    writer = outcomes(records).writeStream.format("parquet").partitionBy("outcome").option("path", path).option("checkpointLocation", checkpoint)
    return _started(writer, once, TRIGGER).start()


def read_outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """The good or the rejected ones: only their folder is read."""
    return spark.read.schema(OUTCOMES).parquet(path).where(F.col("outcome") == outcome)
