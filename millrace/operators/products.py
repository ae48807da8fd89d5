"""The product store: a keyed table and the index of its texts, which follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import store
from millrace.operators.inverted import Index
from millrace.sources import keyed
from millrace.sources.tables import with_ids


class Products:
    """Products by id under a folder; what is written is found by search at once.

    A batch goes into the table first, then into the index. If it stops in between, it is given again under its number: the table replaces the
    batch, the index takes it in.
    """

    def __init__(self, spark: SparkSession, root: str, slices: int = 16) -> None:
        self.spark, self.table, self.slices = spark, f"{root}/products", slices
        self.index = Index(spark, f"{root}/index", list(store.FIELDS))

    def put(self, products: DataFrame, version: int, deleted: str = "deleted") -> None:
        """Inserts and replaces products by id; rows marked ``deleted`` (if there is such a column) go. One row for each id."""
        rows = products if deleted in products.columns else products.withColumn(deleted, F.lit(False))
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(self.slices)).cast("int"))
        keyed.upsert(self.spark, self.table, rows, ["id"], "slice", version, deleted)
        self.index.apply(rows.select("id", *store.FIELDS, deleted), version, deleted)

    def create(self, products: DataFrame, order: str, version: int) -> None:
        """Adds products under new ids, numbered on in ``order``."""
        # A batch that is given again is numbered as before: from the table as it stood then.
        before = keyed.read_keyed(self.spark, self.table, "slice", version)
        self.put(with_ids(products, before.select("id") if before is not None else self.spark.createDataFrame([], "id long"), order), version)

    def read(self) -> DataFrame | None:
        """All products; None before the first."""
        found = keyed.read_keyed(self.spark, self.table, "slice")
        return found.drop("slice") if found is not None else None

    def search(self, query: str | None = None, **asked) -> DataFrame:
        """A page of search documents; the texts are scored by the index."""
        documents = store.flat(self.read())
        return store.search(documents, query, scores=self.index.scores(query, store.FIELDS) if query else None, **asked)
