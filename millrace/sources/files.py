"""Small files and folders by way of Hadoop's file systems, so that they may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place as a whole: written beside it, then renamed."""
    where, fs = _at(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.new")
    stream = fs.create(beside, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"{beside} was not renamed")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    where, fs = _at(spark, path)
    fs.delete(where, True)
