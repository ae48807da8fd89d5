"""Samples of Parquet files by row group: footers tell the groups, a hash of file, group and seed draws them, and only drawn ones are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.workers import importable


@dataclass
class Group(InputPartition):
    """One row group of a file."""

    file: str
    group: int
    bytes: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def drawn(file: str, group: int, seed: int) -> float:
    """A number in [0, 1) that a group of a file always draws; the file counts by its name."""
    told = f"{file.rsplit('/', 1)[-1]}:{group}:{seed}".encode()
    return int.from_bytes(hashlib.blake2b(told, digest_size=6).digest(), "big") / (1 << 48)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.fieldNames()
        self.path, self.fraction, self.seed, self.most = options["path"], float(options.get("fraction", 1)), int(options.get("seed", 0)), int(options.get("groups", 0))

    def partitions(self) -> list[Group]:
        system, at = _opened(self.path)
        info = system.get_file_info(at)
        listed = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet")] if info.type == fs.FileType.Directory else [at]
        groups = []
        for file in sorted(listed):
            footer = pq.read_metadata(file, filesystem=system)
            for g in range(footer.num_row_groups):
                columns = [footer.row_group(g).column(c) for c in range(footer.num_columns)]
                size = sum(c.total_compressed_size for c in columns if c.path_in_schema.split(".")[0] in self.names)
                if drawn(file, g, self.seed) < self.fraction:
                    groups.append(Group(file, g, size))
        groups.sort(key=lambda p: drawn(p.file, p.group, self.seed))
        return groups[: self.most] if self.most else groups

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as f:
            yield from pq.ParquetFile(f).read_row_group(partition.group, columns=self.names).select(self.names).to_batches()


class RowGroups(DataSource):
    """``spark.read.format("row_groups")``: options path, fraction and seed, or groups (so many at most)."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def sample_groups(spark: SparkSession, path: str, *columns: str, fraction: float = 1.0, seed: int = 0, groups: int = 0) -> DataFrame:
    """Whole row groups of a Parquet file or folder, drawn by ``fraction`` and ``seed``; ``groups``: so many of them at most.

    Only the given columns (all without any) of drawn groups are read, a task for each group; the driver reads footers. Files must be in a store that
    pyarrow opens by its address.
    """
    importable(spark)
    spark.dataSource.register(RowGroups)
    schema = spark.read.parquet(path).select(*columns or "*").schema
    reader = spark.read.format("row_groups").schema(schema).option("path", path).option("fraction", fraction).option("seed", seed)
    return reader.option("groups", groups).load()
