import random
from collections import defaultdict

import pytest

from millrace.operators import als
from millrace.plans import catalog
from millrace.sources import tables


def some_pairs(seed):
    rng = random.Random(seed)
    return [(u, p, float(rng.randint(1, 9))) for u in range(40) for p in rng.sample(range(60), 10)]


@pytest.mark.parametrize("name", ["als_top10", "precision_at_k"])
def test_order_lines_are_joined_once(spark, monkeypatch, name):
    rows, counted = some_pairs(1), spark.sparkContext.accumulator(0)
    made = spark.createDataFrame(rows, "user_id long, product_id long, weight double")

    def passed(batches):
        for batch in batches:
            counted.add(len(batch))
            yield batch

    monkeypatch.setattr(tables, "purchases", lambda *_: made.mapInPandas(passed, made.schema))
    assert catalog.QUERIES[name](spark, "").collect() and counted.value == len(rows)


def test_precision_counts_hits_among_the_best_unseen(spark):
    made = spark.createDataFrame(some_pairs(2), "user_id long, product_id long, weight double")
    train, test = als.split(made)
    model, k = als.fit(train), 4
    users, items = ({r.id: r.features for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    seen, real = defaultdict(set), defaultdict(set)
    for frame, by in ((train, seen), (test, real)):
        for r in frame.collect():
            by[r.user_id].add(r.product_id)
    hits = []
    for u in real:
        fetched = sorted((-sum(a * b for a, b in zip(users[u], v, strict=True)), i) for i, v in items.items())[: 3 * k]
        best = [i for _, i in fetched if i not in seen[u]][:k]
        if best:
            hits.append(len(real[u].intersection(best)) / k)
    found = als.precision(model, train, test, k).first()
    assert found.users == len(hits) and found.precision == pytest.approx(sum(hits) / len(hits))
