import pytest
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm import mixing
from millrace.llm.mixing import cells_of, mix, rake


def test_shares_meet_their_targets(spark):
    rows = [(i, "word " * (5 + i % 3), ("en", "de")[i % 5 == 0], ("hot", "a", "b")[0 if i % 3 == 0 else i % 2 + 1], ("x", "y")[i % 7 == 0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string")
    found = mix(docs.withColumn("topic", F.col("theme")), Scratch(spark, "t"), topic="topic", keep=0.1, rounds=30, langs={"en": 0.6, "de": 0.4}, topics={"x": 0.7, "y": 0.3}, sources={"hot": 0.2, "a": 0.4, "b": 0.4})
    rows = found.select("lang", "source", "topic", "n_words", "probability").collect()
    total = sum(r.n_words * r.probability for r in rows)
    assert total == pytest.approx(0.1 * sum(r.n_words for r in rows), rel=1e-6)
    for column, wanted in (("lang", {"en": 0.6, "de": 0.4}), ("source", {"hot": 0.2, "a": 0.4, "b": 0.4}), ("topic", {"x": 0.7, "y": 0.3})):
        for level, share in wanted.items():
            assert sum(r.n_words * r.probability for r in rows if r[column] == level) / total == pytest.approx(share, abs=1e-3)
    assert abs(found.where("kept").count() - found.agg(F.sum("probability")).first()[0]) < 100


def test_no_python_on_the_way(spark, awkward):
    plan = mix(awkward, Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_awkward_and_empty(spark, awkward, empty):
    found = mix(awkward, Scratch(spark, "t")).collect()
    assert len(found) == awkward.count() and all(0 <= r.probability <= 1 for r in found)
    assert len({r.kept for r in found if r.doc_id == 5}) == 1
    assert mix(empty, Scratch(spark, "t")).count() == 0


def test_raking_settles_and_reports_its_error(spark, monkeypatch):
    rows = [(i, "word " * (3 + i % 4), ("en", "en", "de", "fr")[i % 4], ("a", "b")[i % 4 == 0 or i % 7 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = cells_of(docs).groupBy("__source", "__lang", "topic").agg(F.sum("n_words").alias("weight"))
    assert rake(cells, Scratch(spark, "t"), rounds=60)[2] < mixing.SETTLED
    assert rake(cells, Scratch(spark, "t"), rounds=1)[2] > mixing.SETTLED
    monkeypatch.setattr(mixing, "MOST_PAIRS", 2)
    with pytest.raises(ValueError, match="pairs of language and topic"):
        rake(cells, Scratch(spark, "t"))


def test_documents_carry_the_raking_error(spark, empty):
    rows = [(i, "word " * (3 + i % 4), ("en", "en", "de", "fr")[i % 4], ("a", "b")[i % 4 == 0 or i % 7 == 0], 9.0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, raking_error double")
    errors = [{r.raking_error for r in mix(docs, Scratch(spark, "t"), rounds=n).collect()} for n in (1, 60)]
    assert all(len(e) == 1 for e in errors)
    assert errors[0].pop() > mixing.SETTLED > errors[1].pop() >= 0
    assert "raking_error" in mix(empty, Scratch(spark, "t")).columns
