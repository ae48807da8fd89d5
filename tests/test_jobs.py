import pytest
from pyspark.sql import functions as F

from millrace import jobs
from millrace.sources import shared, sinks, tables

EVENT = "id string, user_id int, product_id int, event_type string, created_at string"


def test_archive_then_scores_and_recommendations(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [(str(i), i % 4, i * i % 11 + i % 3, ("view", "purchase")[i % 2], f"2024-01-0{1 + i % 3} 10:00:00") for i in range(40)]
    spark.createDataFrame(rows, EVENT).write.json(f"{root}/in")
    jobs.main(["archive", "--source", f"{root}/in", "--target", f"{root}/archive", "--checkpoint", f"{root}/mark", "--once"])
    assert tables.read_archive(spark, f"{root}/archive").count() == 40
    jobs.main(["popularity", "--source", f"{root}/archive", "--target", f"{root}/scores"])
    assert tables.read_popularity(spark, f"{root}/scores").agg(F.sum("score")).first()[0] == sum(5 if r[3] == "purchase" else 1 for r in rows)
    jobs.main(["similar_items", "--source", f"{root}/archive", "--target", f"{root}/wide", "--count", "3"])
    assert spark.read.parquet(f"{root}/wide").count() > 0
    jobs.main(["counters", "--source", f"{root}/in", "--target", f"{root}/counters", "--checkpoint", f"{root}/mark2", "--once"])
    assert sinks.read_keyed(spark, f"{root}/counters", "slice").agg(F.sum("views"), F.sum("purchases")).first()[:] == (20, 20)


def test_factorise(spark, tmp_path):
    root = f"file://{tmp_path}"
    clicks = [(i, i % 7, "view", i * 5 % 11, None) for i in range(70)] + [(0, None, "view", None, None)]
    spark.createDataFrame(clicks[:-1], "timestamp long, visitorid long, event string, itemid long, transactionid string").write.option("header", True).csv(f"{root}/clicks")
    jobs.main(["factorise", "--source", f"{root}/clicks", "--target", f"{root}/als", "--count", "2"])
    found = tables.read_recommendations(spark, f"{root}/als/recommendations")
    assert found.groupBy("visitorid").count().where("count = 2").count() == 7


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):  # noqa: N802
            return False

    class Far:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("Sc", (), {"getCheckpointDir": staticmethod(Option)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Far())
