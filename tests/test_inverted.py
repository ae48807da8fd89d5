import json
import random

import pytest

from millrace.operators import store
from millrace.operators.inverted import Index
from millrace.operators.products import Products
from millrace.sources import files

SCHEMA = "id long, name string, description string, deleted boolean"
WORDS = "lamp red blue chair table oak pine tall small soft".split()


def scored(frame):
    return {r.id: round(r.score, 9) for r in frame.collect()}


def scanned(spark, live, query, boosts):
    rows = spark.createDataFrame([(i, *v) for i, v in live.items()], "id long, name string, description string")
    best = {}
    for field, boost in boosts.items():
        for r in store.bm25(rows, field, query).collect():
            best[r.id] = max(best.get(r.id, 0.0), r.score * boost)
    return {i: round(s, 9) for i, s in best.items()}


def test_after_every_batch_the_answer_is_that_of_a_scan(spark, tmp_path):
    rng, live = random.Random(5), {}
    index = Index(spark, f"file://{tmp_path}/i", ["name", "description"], least=8, fan=3)
    boosts, sizes = {"name": 2.0, "description": 1.0}, []
    for n in range(7):
        batch = []
        for i in rng.sample(range(40), rng.choice((1, 6, 12))):
            gone = n > 0 and rng.random() < 0.3
            text = None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(7)))
            batch.append((i, text, f"{text} lamp", gone))
            live.pop(i, None)
            if not gone:
                live[i] = (text, f"{text} lamp")
        index.apply(spark.createDataFrame(batch, SCHEMA), n)
        index.apply(spark.createDataFrame([(1, "other", "", False)], SCHEMA), n)  # a repeated batch changes nothing
        now = index.manifest()
        assert now.fields["name"][0] == len(live)
        sizes.append(len(now.segments))
        if n in (2, 6):
            for query in ("Lamp", "red oak", "absent"):
                assert scored(index.scores(query, boosts)) == scanned(spark, live, query, boosts)
    assert max(sizes) <= 5 and min(sizes[3:]) < max(sizes)  # segments were merged
    kept = {s[0] for s in index.manifest().segments}
    assert len([f for f in files.names(spark, f"file://{tmp_path}/i/rows")]) <= len(kept) + 4


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/i", ["name"])
    index.apply(spark.createDataFrame([(1, "lamp", "", False)], SCHEMA), 0)
    with monkeypatch.context() as m, pytest.raises(OSError, match="power"):
        m.setattr(files, "write_text", lambda *_: (_ for _ in ()).throw(OSError("power")))
        index.apply(spark.createDataFrame([(1, "", "", True)], SCHEMA), 1)
    assert list(scored(index.scores("lamp"))) == [1]
    index.apply(spark.createDataFrame([(1, "", "", True), (2, "lamp lamp", "", None)], SCHEMA), 1)
    assert list(scored(index.scores("lamp"))) == [2]


def test_only_the_terms_folders_are_read(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", ["name"])
    index.apply(spark.createDataFrame([(i, f"w{i} common", "", False) for i in range(300)], SCHEMA), 0)
    plan = index.postings(where=(store.F.col("slice") == 3) & (store.F.col("term") == "w7"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan and "EqualTo(term,w7)" in plan


def test_nothing_indexed(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", ["name"])
    assert index.scores("lamp").count() == 0
    index.apply(spark.createDataFrame([], SCHEMA), 0)
    index.apply(spark.createDataFrame([(1, None, None, None), (2, "x", None, True)], SCHEMA), 1)
    assert index.scores("lamp").count() == 0 and index.scores("").count() == 0
    assert json.loads(files.read_text(spark, f"file://{tmp_path}/i/_manifests/1.json"))["fields"] == {"name": [1, 0]}


def test_created_products_are_found_and_deleted_ones_are_not(spark, tmp_path):
    shop = Products(spark, f"file://{tmp_path}/shop", 4)
    schema = "name string, category string, price double, description string, tags array<string>, specifications map<string,string>, images array<string>, location struct<type:string,coordinates:array<double>>, rating struct<average:double,count:int>, asin string"

    def product(name, price):
        return (name, "home", price, "", [], {}, [], None, (1.0, 1), "a")

    for _ in range(2):  # a batch that is given again numbers its products as before
        shop.create(spark.createDataFrame([product("red lamp", 5.0), product("chair", 9.0)], schema), "name", 0)
    shop.create(spark.createDataFrame([product("blue lamp", 7.0)], schema), "name", 1)
    assert sorted((r.id, r.name) for r in shop.read().collect()) == [(1, "chair"), (2, "red lamp"), (3, "blue lamp")]
    assert sorted(r.id for r in shop.search("lamp").collect()) == [2, 3]
    shop.put(shop.read().where("id = 2").withColumn("deleted", store.F.lit(True)), 2)
    assert [r.id for r in shop.search("lamp").collect()] == [3] and shop.search().first().total == 2
