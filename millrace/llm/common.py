"""What several operators of this subpackage share: tables, shared storage and text bounds."""

from __future__ import annotations

import atexit
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions in here remove their shuffle files when they end: a written table, or a collected one, needs them no more."""
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = fresh_path(spark, name)
        atexit.register(self.drop)

    def save(self, frame: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Writes a frame and returns it as read back."""
        where = f"{self.path}/{name}"
        schema = frame.schema
        with tidy(self.spark):
            frame.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them."""
        try:
            jvm, context = self.spark._jvm, self.spark.sparkContext._jsc
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended already
            return


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """The id and text of each document, without other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def crc_bucket(doc_id: Column, buckets: int = 4) -> Column:
    """crc32 of the id as text, modulo ``buckets``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets)


def row_keys(docs: DataFrame) -> DataFrame:
    """Adds ``__id`` (the id, the least long for null) and ``__h`` (hash of the text): what a document row is joined by."""
    least = F.lit(-(1 << 63)).cast("long")
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), least)).withColumn("__h", F.xxhash64("text"))


#: Marks of hashes are 2 ** MARK_BITS bits, so 2 MB at most, however many hashes there are.
MARK_BITS = 24


def mark_words(hashes: DataFrame, column: str, bits: int = MARK_BITS) -> DataFrame:
    """(__word, __bits): a bit for the leading ``bits`` of each hash; at most 2 ** (bits - 6) rows."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    marks = hashes.where(F.col(column).isNotNull()).select(F.shiftright(slot, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    return marks.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))


def marks(hashes: DataFrame, column: str, bits: int = MARK_BITS) -> np.ndarray:
    """The marks as an array of 64-bit words, of a fixed size."""
    with tidy(hashes.sparkSession):
        found = mark_words(hashes, column, bits).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["__word"].to_numpy()] = found["__bits"].to_numpy().view(np.uint64)
    return words


def marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (as unsigned 64-bit) may be among those marked; none that is gets lost."""
    slot = hashes.view(np.uint64) >> np.uint64(64 - MARK_BITS)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def split_by_marks(docs: DataFrame, words: DataFrame, column: str = "__h") -> tuple[DataFrame, DataFrame]:
    """Rows whose hash may be marked, and the rest. words: of mark_words, so small enough to broadcast."""
    slot = F.shiftrightunsigned(F.col(column), 64 - MARK_BITS)
    bit = F.call_function("shiftright", F.col("__bits"), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = (F.shiftright(slot, 6) == F.col("__word")) & bit
    return docs.join(F.broadcast(words), met, "left_semi"), docs.join(F.broadcast(words), met, "left_anti")
