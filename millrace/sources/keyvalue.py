"""Point lookups by key: runs of Parquet files sorted by the key, with Bloom filters, of which a get reads the key's own row groups.

A put is one more run; of several rows for a key the newest run's holds. Once ``fan`` runs of a size class stand at the end they become one. Files of
a run are ranges of the key, so that statistics of files and row groups, and for keys that are not there the Bloom filter, leave one row group at most
of each run to be read. A put counts once its manifest is written; a repeated one does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.manifests import Manifests, end_to_merge, remove_others

#: Rows of a file, bytes of a row group, rows of the smallest size class, runs that become one, how classes grow.
FILE_ROWS, GROUP_BYTES, LEAST, FAN, GROWTH = 2_000_000, 1 << 20, 100_000, 4, 4


class KeyValue:
    """A table of one row for each ``key``, written in puts and read by key."""

    def __init__(self, spark: SparkSession, path: str, key: str, group_bytes: int = GROUP_BYTES, least: int = LEAST, fan: int = FAN) -> None:
        self.spark, self.path, self.key, self.group_bytes, self.least, self.fan = spark, path, key, group_bytes, least, fan
        self.manifests = Manifests(spark, path)

    def _write(self, rows: DataFrame, run: int) -> int:
        """Writes a run and counts it."""
        at = f"{self.path}/run={run}"
        n = rows.count()
        parts = n // FILE_ROWS + 1
        dealt = rows.repartitionByRange(parts, self.key).sortWithinPartitions(self.key)
        options = {"parquet.block.size": self.group_bytes, f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": max(1000, n // parts), "parquet.block.size.row.check.min": 100}
        dealt.write.mode("overwrite").options(**{k: str(v) for k, v in options.items()}).parquet(at)
        return n

    def put(self, rows: DataFrame, version: int) -> None:
        """Puts rows, one for each key, in place of what the keys had."""
        found = self.manifests.last()
        if found and version <= found[0]:
            return
        before = found[1]["runs"] if found else []
        runs = [*before, [2 * version, self._write(rows.where(F.col(self.key).isNotNull()), 2 * version)]]
        first = end_to_merge([n for _, n in runs], self.least, self.fan, GROWTH)
        if first < len(runs):
            runs = [*runs[:first], [2 * version + 1, self._write(self._newest(self._rows(runs[first:])), 2 * version + 1)]]
        self.manifests.write(version, {"runs": runs})
        remove_others(self.spark, self.path, "run=", {r for r, _ in [*runs, *before]})

    def _rows(self, runs: list[list[int]]) -> DataFrame:
        """The runs' rows with ``__at``, the place of their run."""
        rows = self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/run={r}" for r, _ in runs))
        places = F.create_map(*(F.lit(x) for at, (r, _) in enumerate(runs) for x in (r, at)))
        return rows.withColumn("__at", F.element_at(places, F.col("run"))).drop("run")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("__at")))
        return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__at")

    def read(self) -> DataFrame:
        """All rows that hold."""
        return self._newest(self._rows(self.manifests.last()[1]["runs"]))

    def get(self, *keys) -> DataFrame:
        """The rows of some keys; none for a key that is not there."""
        rows = self._rows(self.manifests.last()[1]["runs"])
        # Dictionaries of keys that repeat would stand before the Bloom filter; keys here don't, so that the filter is asked.
        met = rows.where(F.col(self.key) == keys[0]) if len(keys) == 1 else rows.where(F.col(self.key).isin(list(keys)))
        return self._newest(met)


def rows_scanned(frame: DataFrame) -> int:
    """Runs a frame and tells how many rows its file scans gave."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan

    def leaves(p) -> list:
        if p.nodeName().endswith("QueryStage"):
            return leaves(p.plan())
        below = p.children()
        return [x for i in range(below.size()) for x in leaves(below.apply(i))] if below.size() else [p]

    return sum(p.metrics().apply("numOutputRows").value() for p in leaves(plan) if p.metrics().contains("numOutputRows"))
