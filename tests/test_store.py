import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning, store


@pytest.fixture
def documents(spark):
    rows = [
        (1, "red lamp", "home", "acme", 10.0, "a lamp", ["lamp"], 4.0, 3, (40.0, -74.0)),
        (2, "blue lamp lamp", "home", "zeta", 20.0, "", ["blue"], 2.0, 1, (34.0, -118.0)),
        (3, "chair", "office", "acme", 30.0, "sits by a lamp", [], 5.0, 9, None),
    ]
    return spark.createDataFrame(rows, "id int, name string, category string, brand string, price double, description string, tags array<string>, rating_average double, rating_count int, location struct<lat:double,lon:double>")


def ids(frame):
    return [r.id for r in frame.collect()]


def test_filters_and_orders(documents):
    assert ids(store.search(documents, category="home", sort="price_desc")) == [2, 1]
    assert ids(store.search(documents, brand="acme", price_min=10.0, price_max=29.0)) == [1]
    assert ids(store.search(documents, rating_min=4.0, sort="rating_desc")) == [3, 1]
    assert ids(store.search(documents, sort="nonsense")) == [1, 2, 3]
    assert store.search(documents, limit=1, offset=1).first().total == 3


def test_geo_needs_all_three_values(documents):
    assert ids(store.search(documents, lat=40.5, lon=-74.0, radius_km=100.0)) == [1]
    assert len(ids(store.search(documents, lat=40.5, lon=-74.0))) == 3


def test_text_ranks_names_first_and_tags_as_wholes(documents):
    assert ids(store.search(documents, query="lamp"))[:2] == [2, 1]
    assert 2 in ids(store.search(documents, query="blue"))
    assert ids(store.search(documents, query="absent")) == []


def test_pages_and_lookups(documents, spark):
    assert ids(store.page(documents, 1, 1)) == [2]
    assert sorted(ids(store.by_id(documents, 1, 3, 77))) == [1, 3]
    users = spark.createDataFrame([(1, "FRANCE"), (2, "PERU")], "id int, country string")
    assert ids(store.by_country(users, "PERU")) == [2] and len(ids(store.by_country(users, ""))) == 2


def test_cleaning_rules(spark):
    schema = "title string, price string, store string, details string, description array<string>, images struct<large:array<string>>, average_rating double, rating_number long, parent_asin string"
    good = ("A long title", "12.345", "", '{"Brand": "Acme"}', [], (["u"],), None, None, "x")
    rows = [good, ("short", *good[1:]), (good[0], "None", *good[2:]), (good[0], "abc", *good[2:]), (good[0], "2001", *good[2:]), (*good[:5], ([],), *good[6:])]
    found = cleaning.clean(spark.createDataFrame(rows, schema), "Home_Kitchen").collect()
    assert [(r.name, r.category, r.price, r.brand, r.description, r.rating_count) for r in found] == [("A long title", "home kitchen", 12.35, "Acme", "A long title", 0)] or found[0].price == pytest.approx(12.345, abs=0.006)
    assert len(found) == 1
    many = spark.range(10).select(F.col("id"), (F.col("id") % 2).cast("string").alias("category"))
    assert cleaning.first_of_each(many, 3).count() == 6
