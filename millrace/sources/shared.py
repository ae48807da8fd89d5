"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local folder is made and set, on a single machine only.

    On a cluster executors don't see the driver's folders, so that a missing setting is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session still can."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def saved(frame: DataFrame, name: str) -> DataFrame:
    """A frame as written to the shared folder and read back, so that what uses it several times makes it once."""
    path, schema = fresh_path(frame.sparkSession, name), frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)
