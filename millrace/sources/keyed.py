"""Keyed tables: rows are replaced by key, partition by partition, under a small pointer file.

A batch writes the partitions it touches, whole, as ``version=N``; then the pointer ``_pointers/N.json`` names the version of every partition, and
the batch counts. A crash before that leaves the table as it was. Partition folders that neither this pointer nor the one before it names are removed, so that a
table has as many folders as partitions and those of one batch besides, and a batch costs the same however many came before. Readers that started under the
pointer before still find their files.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import files

#: Fixed value: how Spark names the folder of the null partition.
NONE = "__HIVE_DEFAULT_PARTITION__"


def _pointers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/_pointers") if n.endswith(".json") and not n.startswith("."))


def _pointer(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int] | None:
    """Partition folder to version, by the last complete pointer (before a version); None if there is none."""
    for v in reversed(_pointers(spark, path)):
        if (before is None or v < before) and files.exists(spark, f"{path}/version={v}/_SUCCESS"):
            return json.loads(files.read_text(spark, f"{path}/_pointers/{v}.json"))
    return None


def _rows(spark: SparkSession, path: str, pointer: dict[str, int]) -> DataFrame | None:
    found = sorted(f"{path}/version={v}/{folder}" for folder, v in pointer.items())
    return spark.read.option("basePath", path).parquet(*found).drop("version") if found else None


def read_keyed(spark: SparkSession, path: str, partition: str, before: int | None = None) -> DataFrame | None:
    """A keyed table as it stands (or stood before the last version); None if there is none. ``partition`` is its partition column."""
    pointer = _pointer(spark, path, before)
    return _rows(spark, path, pointer) if pointer is not None else None


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], partition: str, version: int, deleted: str | None = None) -> None:
    """Replaces rows of a keyed table by key; keys may be null, and a row's partition must follow from its key.

    A repeated version replaces itself; one older than the table's is an error. Partitions that a batch does not touch are neither read nor written. Of
    several rows for a key in one batch the caller keeps one. deleted: a boolean column, not stored, of rows whose key only goes.
    """
    if any(v > version for v in _pointers(spark, path)):
        raise ValueError(f"version {version} is older than the table's")
    old = _pointer(spark, path, version) or {}
    kept = rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
    columns, merged = kept.columns, kept
    if old:
        # A value for each partition that the batch touches: the table's own folders bound it.
        touched = [r[0] for r in rows.select(partition).distinct().collect()]
        table = _rows(spark, path, old)
        wanted = table[partition].isin([t for t in touched if t is not None])
        here = table.where(wanted | table[partition].isNull() if None in touched else wanted)
        new = rows.select(*(F.col(k).alias(f"__{k}") for k in keys))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        merged = here.join(new, same, "left_anti").select(*columns).unionByName(kept)
    merged.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/version={version}")
    written = [n for n in files.names(spark, f"{path}/version={version}") if n.startswith(f"{partition}=")]
    pointer = old | dict.fromkeys(written, version)
    if deleted and old:  # a partition that lost all its rows has no folder
        gone = {NONE if t is None else str(t) for t in touched}
        for folder in set(old) - set(written):
            if unquote(folder.removeprefix(f"{partition}=")) in gone:
                pointer.pop(folder)
    files.write_text(spark, f"{path}/_pointers/{version}.json", json.dumps(pointer, sort_keys=True))
    _tidy(spark, path, pointer, old)


def _tidy(spark: SparkSession, path: str, pointer: dict[str, int], old: dict[str, int]) -> None:
    """Removes what neither pointer names."""
    named = set(pointer.items()) | set(old.items())
    versions = {v for _, v in named}
    last_two = _pointers(spark, path)[-2:]
    for v in _pointers(spark, path):
        if v not in last_two:
            files.remove(spark, f"{path}/_pointers/{v}.json")
    for name in files.names(spark, path):
        if name.startswith("version="):
            v = int(name.removeprefix("version="))
            if v not in versions and v not in last_two:
                files.remove(spark, f"{path}/{name}")
            else:
                for folder in files.names(spark, f"{path}/{name}"):
                    if "=" in folder and (folder, v) not in named:
                        files.remove(spark, f"{path}/{name}/{folder}")
