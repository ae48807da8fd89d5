"""Manifests of tables made of runs: small JSON files by version, of which the last complete one holds."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from millrace.sources import files


class Manifests:
    """The manifests of a table; only the last two are kept, the one before for readers that started under it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path}/_manifests"

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in files.names(self.spark, self.path) if n.endswith(".json") and not n.startswith("."))

    def last(self) -> tuple[int, dict] | None:
        """Version and content of the last manifest; None before the first."""
        found = self.versions()
        return (found[-1], json.loads(files.read_text(self.spark, f"{self.path}/{found[-1]}.json"))) if found else None

    def write(self, version: int, content: dict) -> None:
        """Commits a version."""
        files.write_text(self.spark, f"{self.path}/{version}.json", json.dumps(content))
        for v in self.versions()[:-2]:
            files.remove(self.spark, f"{self.path}/{v}.json")


def remove_others(spark: SparkSession, folder: str, prefix: str, kept: set[int]) -> None:
    """Removes the numbered sub-folders that are not to be kept."""
    for name in files.names(spark, folder):
        if name.startswith(prefix) and int(name.removeprefix(prefix)) not in kept:
            files.remove(spark, f"{folder}/{name}")


def tier(size: int, least: int, growth: int) -> int:
    """The size class of a run: 0 up to ``least`` rows, one more for each ``growth``-fold."""
    n = 0
    while size > least:
        n, least = n + 1, least * growth
    return n


def end_to_merge(sizes: list[int], least: int, fan: int, growth: int) -> int:
    """Where the longest end of runs (old to new) begins that are of one size class or smaller ones and ``fan`` or more; their number if there is none."""
    first, tiers = len(sizes), [tier(s, least, growth) for s in sizes]
    for top in range(max(tiers, default=0) + 1):
        at = len(sizes)
        while at and tiers[at - 1] <= top:
            at -= 1
        if len(sizes) - at >= fan:
            first = at
    return first
