import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import similar, tuning
from millrace.sources import tables
from millrace.streaming import bursts
from millrace.streaming import queries as streams
from millrace.streaming.similarity import Similarity

EVENT = "id string, user_id int, product_id int, event_type string, created_at string"


def test_similarity_equals_the_batch_form_after_every_batch(spark, tmp_path):
    rng, seen = random.Random(4), []
    kept = Similarity(spark, f"file://{tmp_path}/s", 4)
    for n in range(4):
        batch = [(f"{n}-{i}", rng.randrange(6), rng.randrange(8), rng.choice(("view", "add_to_cart", "purchase", "other")), "2024-01-01") for i in range(12)] + [("x", None, 1, "view", ""), ("y", 1, None, "view", "")]
        seen += batch
        kept.apply(spark.createDataFrame(batch, EVENT), n)
        if n == 2:
            kept.apply(spark.createDataFrame(batch, EVENT), n)  # given again
        if n % 2:
            wanted = {(r.a, r.b): round(r.score, 9) for r in similar.cosine(similar.interactions(spark.createDataFrame(seen, EVENT))).collect()}
            assert {(r.a, r.b): round(r.score, 9) for r in kept.cosine().collect()} == wanted


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    kept = Similarity(spark, f"file://{tmp_path}/s", 8)
    kept.apply(spark.createDataFrame([(str(i), i // 2, i, "view", "") for i in range(40)], EVENT), 0)
    kept.apply(spark.createDataFrame([("n", 3, 6, "purchase", "")], EVENT), 1)
    for name in ("weights", "dots", "norms"):
        assert len(list((tmp_path / "s" / name / "version=1").glob("slice=*"))) == 1
    assert kept.norms().where("square > 1").count() == 1


def moments(*hours):
    return [f"2024-01-01 {h:02d}:{m:02d}:00" if h < 24 else f"2024-01-{1 + h // 24:02d} {h % 24:02d}:{m:02d}:00" for h, n in hours for m in range(n)]


@pytest.mark.parametrize("files", [1, 4])
def test_bursts_equal_the_batch_form_and_end_in_silence(spark, tmp_path, files):
    steady = [("view", t) for t in moments((0, 2), (1, 20), (2, 18), (3, 2), (4, 30), (5, 1), (6, 1))]
    silent = [("purchase", t) for t in moments((0, 1), (1, 25), (9, 30), (10, 2))] + [("cart", t) for t in moments((2, 1), (3, 40))]
    rows = sorted([*steady, *silent], key=lambda r: r[1]) + [("end", "2024-01-20 00:00:00"), ("end", "2024-01-20 05:00:00")]
    made = spark.createDataFrame([(str(i), 1, 1, k, t) for i, (k, t) in enumerate(rows)], EVENT)
    for part in range(files):
        made.where((F.col("id").cast("int") >= len(rows) * part // files) & (F.col("id").cast("int") < len(rows) * (part + 1) // files)).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = tables.stream_files(spark, f"file://{tmp_path}/in", 1)
    bursts.write_bursts(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", once=True, threshold=15).awaitTermination()
    found = spark.read.schema(bursts.SCHEMA).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"file://{tmp_path}/out")
    got = sorted((r.source, str(r["at"])[8:16], r.mode, r.delta) for r in found.where("source <> 'end'").collect())
    hours = spark.createDataFrame([r[:2] for r in steady], "source string, t string").groupBy("source", F.date_trunc("hour", F.col("t").cast("timestamp")).alias("at")).count()
    totals = hours.withColumn("total", F.sum("count").over(similar.Window.partitionBy("source").orderBy("at")))
    wanted = sorted((r.source, str(r["at"])[8:16], r.mode, r.delta) for r in tuning.bursts(totals, 15).collect())
    assert [g for g in got if g[0] == "view"] == wanted
    # A source that falls silent is normal after 90 minutes: by the gap before its next sample, or by timer alone.
    assert [g for g in got if g[0] != "view"] == sorted([("purchase", "01 01:00", "burst", 25), ("purchase", "01 02:30", "normal", 0), ("purchase", "01 09:00", "burst", 30), ("purchase", "01 10:00", "normal", 2), ("cart", "01 03:00", "burst", 40), ("cart", "01 04:30", "normal", 0)])


def test_two_queries_of_one_application(spark, tmp_path):
    rows = [(str(i), 1, 1, "view", f"2024-01-01 {i:02d}:00:00") for i in range(10)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.json(f"file://{tmp_path}/in")
    running = threading.Thread(target=streams.run_all, args=(spark, tables.stream_files(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out"))
    running.start()
    try:
        for _ in range(300):
            active = spark.streams.active
            if len(active) == 2 and all(q.lastProgress for q in active):
                break
            time.sleep(0.2)
        # Each of them has read all events.
        assert [streams.progress(q)["numInputRows"] for q in active] == [10, 10]
    finally:
        for q in spark.streams.active:  # the application ends with the first of them
            q.stop()
        running.join(30)
    assert not running.is_alive()
    assert all((tmp_path / "out" / "checkpoints" / k / "offsets" / "0").exists() for k in ("sessions", "anomalies"))
