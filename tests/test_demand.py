import statistics

from pyspark.sql import functions as F

from millrace.operators import demand as d
from millrace.sources import sinks, tables
from millrace.streaming import queries as streams


def test_sessions_split_beyond_the_gap_only(events):
    made = events((1, 5, "view", "2024-01-01 00:00:00"), (1, 6, "view", "2024-01-01 00:05:00"), (1, 7, "view", "2024-01-01 00:10:01"), (2, 5, "view", "2024-01-01 00:00:00"))
    found = sorted((r.user_id, r.event_count, r.products) for r in d.sessions(made).collect())
    assert found == [(1, 1, [7]), (1, 2, [5, 6]), (2, 1, [5])]


def test_scores_use_earlier_counts_only(spark):
    counts = [2, 3, 2, 3, 2, 60]
    made = spark.createDataFrame([(1, f"2024-01-01 0{i}:00:00", c) for i, c in enumerate(counts)], "product_id int, bucket string, event_count int")
    found = {r.bucket[12]: r.z for r in d.z_scores(made).collect()}
    assert set(found) == {"3", "4", "5"}
    assert abs(found["5"] - (60 - statistics.mean(counts[:5])) / statistics.pstdev(counts[:5])) < 1e-9
    assert d.anomalies(d.z_scores(made)).count() == 1


def test_scores_of_busy_products_stay_exact(spark):
    counts = [2_000_000_000 + 7 * i % 5 for i in range(6)]
    made = spark.createDataFrame([(1, f"2024-01-01 0{i}:00:00", c) for i, c in enumerate(counts)], "product_id int, bucket string, event_count int")
    found = {int(r.bucket[12]): r.z for r in d.z_scores(made.selectExpr("product_id", "bucket", "event_count")).collect()}
    for i, z in found.items():
        before = [c - 2_000_000_000 for c in counts[:i]]
        assert abs(z - (counts[i] - 2_000_000_000 - statistics.mean(before)) / statistics.pstdev(before)) < 1e-6


def test_scores_need_spread(spark):
    made = spark.createDataFrame([(1, f"2024-01-01 0{i}:00:00", 4) for i in range(6)], "product_id int, bucket string, event_count int")
    assert d.z_scores(made).count() == 0


def test_series_and_hours(events):
    made = d.counts(events((1, 5, "view", "2024-01-02 03:04:05"), (1, 5, "view", "2024-01-02 03:04:50"), (1, 5, "view", "2024-01-01 01:00:00"), (1, 6, "view", "2024-01-02 03:04:05")))
    assert [r.event_count for r in d.series(made, 5, "2024-01-02", 1).collect()] == [2, 1]
    assert sorted((r.product_id, r.event_hour, r.event_count) for r in d.hourly(made).collect()) == [(5, 1, 1), (5, 3, 2), (6, 3, 1)]


def _files(spark, tmp_path, rows):
    made = spark.createDataFrame(rows, "id string, user_id int, product_id int, event_type string, created_at string")
    made.repartitionByRange(3, "created_at").write.json(f"file://{tmp_path}/in")
    return tables.stream_files(spark, f"file://{tmp_path}/in")


def test_streams_agree_with_batch(spark, tmp_path, events):
    rows = [(str(i), i % 3, i % 4, "view", f"2024-01-01 {h:02d}:{i % 60:02d}:00") for h in range(8) for i in range(h * 7 % 11 + 3)]
    batch = events(*((r[1], r[2], r[3], r[4]) for r in rows))
    stream = _files(spark, tmp_path, [*rows, ("end", 9, 9, "view", "2025-01-01 00:00:00")])
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    streams.write_demand(stream, f"{out}/demand", f"{mark}/demand", once=True, grain="1 hour").awaitTermination()
    wanted = sorted((r.product_id, r.event_count) for r in d.counts(batch, "hour").collect())
    assert sorted((r.product_id, r.event_count) for r in sinks.read_keyed(spark, f"{out}/demand", "bucket_date").where("product_id < 9").collect()) == wanted
    streams.write_sessions(stream, f"{out}/sessions", f"{mark}/sessions", once=True).awaitTermination()
    closed = spark.read.json(f"{out}/sessions")
    assert sorted((r.user_id, r.event_count) for r in closed.collect()) == sorted((r.user_id, r.event_count) for r in d.sessions(batch).collect())
    found = streams.write_anomalies(stream, f"{out}/z", f"{mark}/z", once=True, grain="1 hour", threshold=0.5)
    found.awaitTermination()
    z = spark.read.schema("product_id int, bucket timestamp, event_count int, z double").json(f"{out}/z")
    assert sorted(round(r.z, 6) for r in z.collect()) == sorted(round(r.z, 6) for r in d.anomalies(d.z_scores(d.counts(batch, "hour")), 0.5).collect())


def test_late_events_are_dropped(spark, tmp_path):
    first = [("1", 1, 1, "view", "2024-01-01 10:00:00"), ("2", 1, 1, "view", "2024-01-01 12:00:00")]
    stream = _files(spark, tmp_path, first)
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    streams.write_sessions(stream, out, mark, once=True).awaitTermination()
    spark.createDataFrame([("3", 1, 1, "view", "2024-01-01 10:01:00"), ("4", 1, 1, "view", "2024-01-01 14:00:00")], "id string, user_id int, product_id int, event_type string, created_at string").coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    streams.write_sessions(stream, out, mark, once=True).awaitTermination()
    found = spark.read.json(out)
    assert found.agg(F.sum("event_count")).first()[0] == 2
