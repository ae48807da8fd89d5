from pyspark.sql import functions as F

from millrace.sources import created, files
from millrace.sources.keyvalue import KeyValue, rows_scanned


def test_a_get_reads_one_row_group_of_each_run(spark, tmp_path):
    table = KeyValue(spark, f"file://{tmp_path}/kv", "k", group_bytes=16 << 10)
    rows = spark.range(20_000).select((F.col("id") * 2).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.put(rows, 0)
    table.put(rows.where("k % 400 = 0").withColumn("v", F.lit("new")), 1)
    assert [r.v for r in table.get(4000).collect()] == ["new"]
    assert 0 < rows_scanned(table.get(4000)) < 1500 and rows_scanned(table.get(4002)) < 1500
    assert rows_scanned(table.get(4001)) == 0  # between two keys: the Bloom filter tells
    assert sorted(r.k for r in table.get(0, 7, 39_998, 99_999_999).collect()) == [0, 39_998]
    assert table.read().count() == 20_000 and table.read().where("v = 'new'").count() == 100


def test_puts_become_fewer_runs(spark, tmp_path):
    table = KeyValue(spark, f"file://{tmp_path}/kv", "k", least=50, fan=3)
    for n in range(7):
        table.put(spark.createDataFrame([(i, f"{n}") for i in range(n, 30 + n)] + [(None, "x")], "k int, v string"), n)
        table.put(spark.createDataFrame([(0, "again")], "k int, v string"), n)  # a repeated put
    assert {r.k: r.v for r in table.read().collect()} == {k: str(min(k, 6)) for k in range(36)}
    runs = [n for n in files.names(spark, f"file://{tmp_path}/kv") if n.startswith("run=")]
    assert len(table.manifests.last()[1]["runs"]) <= 3 and len(runs) <= 6


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    root = f"file://{tmp_path}/made"
    created.ensure(spark, "shop_test", root)
    counters = spark.range(500).selectExpr("cast(id as int) product_id", "id views", "id add_to_carts", "id purchases")
    created.insert(counters, "shop_test", created.COUNTERS)
    created.ensure(spark, "shop_test", root)  # what is there stays
    created.insert(counters.selectExpr("product_id", "cast(product_id as string) name", "1.0D price"), "shop_test", created.NAMES)
    left, right = spark.table("shop_test.product_counters"), spark.table("shop_test.product_names")
    joined = left.join(right.hint("merge"), "product_id")
    assert joined.count() == 500
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    grouped = left.groupBy("product_id").agg(F.sum("views"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert len([f for f in files.names(spark, f"{root}/product_counters") if f.endswith(".parquet")]) == created.COUNTERS.buckets
    spark.sql("DROP DATABASE shop_test CASCADE")
