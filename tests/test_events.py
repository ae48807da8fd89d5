from pyspark.sql import functions as F

from millrace.operators import events as ev
from millrace.sources import sinks, tables


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_validation_coerces_numbers_and_names_reasons(spark):
    made = spark.createDataFrame([("1", "2", "view"), ("x", "2", "view"), ("1", None, "view"), ("1", "2", "click"), ("1", "2", None)], "user_id string, product_id string, event_type string")
    assert [r.reason for r in ev.validate(made).collect()] == [None, "not_a_number", "missing", "unknown_type", "missing"]
    accepted, refused = ev.ingest(made)
    assert (accepted.count(), refused.count()) == (1, 4)


def test_popularity_weighs_and_drops_unknown_types(events):
    made = events((1, 100, "view"), (2, 100, "view"), (1, 200, "purchase"), (1, 200, "add_to_cart"), (1, 300, "click"), (1, None, "view"))
    assert rows(ev.popularity(made), "product_id", "score") == [(100, 2), (200, 8)]


def test_popularity_of_nothing(events):
    assert ev.popularity(events((1, 1, "click"))).count() == 0


def test_lines_skip_blank_malformed_and_keep_the_rest(spark):
    lines = spark.createDataFrame([('{"id": "1", "product_id": 5, "event_type": "view"}',), ("",), ("   ",), ("{broken",)], "value string")
    assert rows(tables.parse_lines(lines), "id", "product_id") == [("1", 5)]


def test_counters_and_days_treat_unknown_types_differently(events):
    made = events((1, 1, "view"), (1, 1, "click"), (1, 1, "purchase"))
    assert rows(ev.product_counters(made), "product_id", "views", "add_to_carts", "purchases") == [(1, 1, 0, 1)]
    days = ev.daily_counts(made)
    assert sorted(r["event_type"] for r in days.collect()) == ["click", "purchase", "view"]
    assert ev.daily_pivot(days).first().asDict() | {"day": None} == {"day": None, "view": 1, "add_to_cart": 0, "purchase": 1}
    assert ev.daily_summary(days, 2).count() == 2


def test_top_products_break_ties_by_id(events):
    made = ev.product_counters(events((1, 9, "view"), (1, 3, "view"), (1, 5, "purchase")))
    assert [r.product_id for r in ev.top_products(made, 3).collect()] == [5, 3, 9]


def test_archive_comes_back_by_day(spark, events, tmp_path):
    path = f"file://{tmp_path}/archive"
    made = events((1, 1, "view", "2024-01-01 10:00:00"), (1, 2, "view", "2024-01-02 10:00:00")).withColumn("created_at", F.col("created_at").cast("string"))
    sinks.write_archive(made, path)
    assert rows(tables.read_archive(spark, path).withColumn("dt", F.col("dt").cast("string")), "dt", "product_id") == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_upsert_replaces_by_key_and_outlives_crashes(spark, tmp_path):
    path, schema = f"file://{tmp_path}/table", "day string, k int, v int"

    def put(version, *given):
        sinks.upsert(spark, path, spark.createDataFrame(list(given), schema), ["day", "k"], "day", version)

    def table():
        return rows(sinks.read_keyed(spark, path, "day").select("day", "k", "v").fillna("none"), "day", "k", "v")

    assert sinks.read_keyed(spark, path, "day") is None
    put(0, ("a", 1, 1), ("a", 2, 2), ("b", 1, 9), (None, 1, 4))
    put(1, ("a", 2, 5), ("a", 3, 3), (None, 1, 6))
    wanted = [("a", 1, 1), ("a", 2, 5), ("a", 3, 3), ("b", 1, 9), ("none", 1, 6)]
    assert table() == wanted
    put(1, ("a", 2, 5), ("a", 3, 3), (None, 1, 6))  # a repeated batch
    assert table() == wanted
    put(2, ("b", 1, 0))
    (tmp_path / "table" / "version=2" / "_SUCCESS").unlink()  # one that did not end
    assert table() == wanted
    put(2, ("b", 1, 7))
    assert table() == [*wanted[:3], ("b", 1, 7), wanted[4]]


def test_ids_go_on_densely(spark):
    made = tables.with_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), spark.createDataFrame([(7,)], "id long"), "name")
    assert rows(made, "id", "name") == [(8, "a"), (9, "b"), (10, "c")]
    many = tables.with_ids(spark.range(1000).selectExpr("(id * 7919) % 1000 as n", "'old' as id"), made.limit(0), "n", 8)
    assert rows(many, "n", "id") == [(n, n + 1) for n in range(1000)]
    assert tables.with_ids(made.select("name").limit(0), made, "name").count() == 0


def test_generated_events_are_valid(spark):
    made = tables.generate_events(spark, 200, 5, 7)
    assert ev.validate(made).where("not valid").count() == 0
