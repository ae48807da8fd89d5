import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.sources import strict
from millrace.streaming import checked

GOOD = {"id": "1", "user_id": 1, "product_id": 2, "event_type": "view", "created_at": "2024-01-01"}


def line(**more):
    return json.dumps(GOOD | more)


CASES = [
    (line(), None), (f"  {line()}\t", None), (line(extra=1), None), ("", "blank"), (" \t", "blank"), (None, "blank"), ("{broken", "not_json"), (line() + " tail", "not_json"), (line() + line(), "not_json"), (line() + "," + line(), "not_json"),
    (f"{line()}], [1", "not_json"), (f'{line()}, "end": true', "not_json"), (line().replace('"', "'"), "not_json"), ("[1]", "not_json"), (f"[{line()}]", "not_json"), ("null", "not_json"), ("3", "not_json"),
    (line(user_id="x"), "wrong_type"), (line(product_id=1.5), "wrong_type"), (line(user_id=1 << 40), "wrong_type"), (line(user_id=None), "missing"), ("{}", "missing"), (line(event_type="click"), "unknown_type"),
]


def test_reasons(spark):
    found = strict.parse(spark.createDataFrame([(v, i) for i, (v, _) in enumerate(CASES)], "value string, n int"), "mark")
    assert {r.n: r.reason for r in found.collect()} == dict(enumerate(r for _, r in CASES))
    assert strict.parse(spark.createDataFrame([(v,) for v, _ in CASES], "value string"), "skip").count() == 3


def test_strict_policy_fails_with_the_record(spark):
    good = spark.createDataFrame([(line(),)] * 3, "value string")
    assert strict.parse(good, "fail").count() == 3
    with pytest.raises(Exception, match="bad record .not_json.: .broken"):
        strict.parse(good.unionByName(spark.createDataFrame([("{broken",)], "value string")), "fail").collect()
    with pytest.raises(ValueError, match="no policy"):
        strict.parse(good, "other")


def test_good_and_rejected_make_up_the_input_over_restarts(spark, tmp_path):
    root = f"file://{tmp_path}"

    def put(*values):
        spark.createDataFrame([(v,) for v in values if v is not None], "value string").coalesce(1).write.mode("append").text(f"{root}/in")

    def run():
        checked.write_checked(checked.stream_records(spark, f"{root}/in", 1), f"{root}/out", f"{root}/mark", once=True).awaitTermination()

    put(*(v for v, _ in CASES))
    run()
    put(line(id="2"), "{junk")
    run()
    # The last batch's commit is lost: it runs again after the restart, and its files count once.
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    put(line(id="3"))
    run()
    good, bad = (checked.read_outcome(spark, f"{root}/out", k) for k in ("good", "rejected"))
    lines = sum(v is not None for v, _ in CASES) + 3
    assert good.count() == 3 + 2 and good.count() + bad.count() == lines
    assert bad.where("reason = 'not_json'").count() == sum(r == "not_json" for _, r in CASES) + 1
    assert bad.where("value IS NULL OR place NOT LIKE '%/in/%'").count() == 0 and good.where("value IS NOT NULL").count() == 0
    assert sorted(r.id for r in good.select("id").collect()) == ["1", "1", "1", "2", "3"]
    assert Path(tmp_path / "out" / "outcome=good").is_dir()
    shutil.rmtree(tmp_path / "in")


def test_places_of_topic_records(spark):
    raw = spark.createDataFrame([(b"x", "events", 3, 17)], "value binary, topic string, partition int, offset long")
    assert checked.kafka_places(raw).first()[:] == ("x", "events:3:17")
    assert checked.outcomes(checked.kafka_places(raw)).select(F.col("outcome"), "place").first()[:] == ("rejected", "events:3:17")
