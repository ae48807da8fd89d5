import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import demand
from millrace.operators.tiers import Tiers
from millrace.sources import presence, tables
from millrace.sources.rowgroups import drawn, sample_groups
from millrace.streaming import progress
from millrace.streaming import queries as streams

EVENT = "id string, user_id int, product_id int, event_type string, created_at string"


def test_tiers_hold_every_count_once_while_strategies_change(spark, tmp_path, events):
    tiers, seen = Tiers(spark, f"file://{tmp_path}/t", hot=5, lookback=60, slices=2), []
    days = [("2024-01-01 10:30:00", {1: 8, 2: 2}), ("2024-01-01 11:40:00", {1: 1, 2: 9, 3: 1}), ("2024-01-02 11:30:00", {1: 7, 2: 1}), ("2024-01-03 10:50:00", {3: 6})]
    kinds = []
    for n, (at, counts) in enumerate(days):
        batch = [(1, p, "view", f"{at[:14]}{i:02d}:30") for p, c in counts.items() for i in range(c)]
        seen += batch
        rolled = demand.counts(events(*batch))
        tiers.roll(rolled, at, n)
        tiers.roll(rolled, at, n)  # given again
        kinds.append({r.product_id: r.granularity for r in tiers.strategies().collect()})
        wanted = sorted(tuple(r) for r in demand.hourly(demand.counts(events(*seen))).collect())
        assert sorted(tuple(r) for r in tiers.by_hour().collect()) == wanted
        cold = [p for p, k in kinds[-1].items() if k == "cold"]
        assert tiers.minutes().where(F.col("product_id").isin(cold)).count() == 0
    assert kinds == [{1: "hot", 2: "cold"}, {1: "cold", 2: "hot", 3: "cold"}, {1: "hot", 2: "cold", 3: "cold"}, {1: "cold", 2: "cold", 3: "hot"}]
    assert [(r.grain, r.event_count) for r in tiers.series(1).collect()] == [("hour", 7), ("hour", 1), ("hour", 8)]
    assert [r.grain for r in tiers.series(3).collect()] == ["minute"] * 6 + ["hour"]


def test_progress_rows_hold_each_batch(spark, tmp_path):
    for n in (3, 5, 4):
        spark.createDataFrame([(str(i), 1, 1, "view", "2024-01-01 00:00:00") for i in range(n)], EVENT).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    listener = progress.ProgressRows(spark, f"file://{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        streams.write_archive(tables.stream_files(spark, f"file://{tmp_path}/in", 1), f"file://{tmp_path}/out", f"file://{tmp_path}/mark", once=True).awaitTermination()
        for _ in range(50):
            if list((tmp_path / "progress").glob("*-end.json")):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    found = progress.read_progress(spark, f"file://{tmp_path}/progress")
    assert sorted(r.rows_in for r in found.where("rows_in > 0").collect()) == [3, 4, 5]
    assert [r.ended for r in found.where("ended IS NOT NULL").collect()] == ["finished"]


def test_counts_come_from_the_write_itself(spark, tmp_path, events):
    made = events((1, 1, "view"), (1, None, "view"), (None, 1, "view"), (1, 1, "click"), (2, 2, "purchase"))
    assert progress.write_observed(made, f"file://{tmp_path}/valid") == {"events": 5, "valid": 2, "missing": 2, "unknown_type": 1}
    assert spark.read.parquet(f"file://{tmp_path}/valid").count() == 2


def test_presence_prunes_days_while_the_query_runs(spark, tmp_path):
    rows = spark.range(3000).selectExpr("cast(id % 300 as int) product_id", "date_add(date'2024-01-01', cast(id % 30 as int)) bucket_date", "id event_count")
    rows.write.partitionBy("bucket_date").parquet(f"file://{tmp_path}/demand")
    rows.select("bucket_date", "product_id").distinct().write.parquet(f"file://{tmp_path}/days")
    stored, seen = spark.read.parquet(f"file://{tmp_path}/demand"), spark.read.parquet(f"file://{tmp_path}/days")
    found = presence.minutes_of(stored, seen, F.col("product_id") == 7)
    assert found.count() == 10 and "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    assert presence.partitions_read(presence.minutes_of(stored, seen, F.col("product_id") == 7)) == 1
    assert presence.partitions_read(stored) == 30


@pytest.mark.parametrize("whole", [True, False])
def test_row_groups_are_drawn_alike_each_time(spark, tmp_path, whole):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for f in range(2):
        pq.write_table(pa.table({"k": range(f * 1000, f * 1000 + 1000), "v": ["x" * 50] * 1000}), tmp_path / f"{f}.parquet", row_group_size=100)
    path = f"file://{tmp_path}" if whole else f"{tmp_path}/1.parquet"
    files = (0, 1) if whole else (1,)
    wanted = {f * 1000 + g * 100 for f in files for g in range(10) if drawn(f"{f}.parquet", g, 3) < 0.4}
    for _ in range(2):
        found = sample_groups(spark, path, "k", fraction=0.4, seed=3)
        assert {k // 100 * 100 for (k,) in found.collect()} == wanted and found.count() == 100 * len(wanted)
    assert found.columns == ["k"] and 0 < len(wanted) < 10 * len(files)
    assert sample_groups(spark, path, groups=1, seed=1).count() == 100
    assert sample_groups(spark, path).count() == 1000 * len(files)
