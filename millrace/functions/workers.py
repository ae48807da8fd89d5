"""Python workers import this package from where the driver found it, unless the cluster ships it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Puts the package's folder on the path of workers that start from now on."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def map_pandas(frame: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInPandas`` whose function may live in this package."""
    importable(frame.sparkSession)
    return frame.mapInPandas(function, schema)


def map_arrow(frame: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose function may live in this package."""
    importable(frame.sparkSession)
    return frame.mapInArrow(function, schema)
