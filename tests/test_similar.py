import math
import random
from collections import defaultdict

import pytest

from millrace.operators import als
from millrace.operators import similar as s
from millrace.sources import sinks


KINDS = ("view", "add_to_cart", "purchase", "signup")


def random_events(seed, users=9, items=14, n=160):
    rng = random.Random(seed)
    return [(rng.randrange(users), 500 + rng.randrange(items), rng.choice(KINDS)) for _ in range(n)]


def vectors(rows, unknown=1.0):
    """Each item's weights by user, summed one by one."""
    out = defaultdict(lambda: defaultdict(float))
    for user, item, kind in rows:
        out[item][user] += {"view": 1.0, "add_to_cart": 3.0, "purchase": 5.0}.get(kind, unknown)
    return out


def test_weights_are_sums_under_either_policy(events):
    rows = random_events(1)
    for policy, unknown in (("one", 1.0), ("zero", 0.0)):
        wanted = {(u, i): w for i, by in vectors(rows, unknown).items() for u, w in by.items()}
        assert {(r.user_id, r.product_id): r.weight for r in s.interactions(events(*rows), policy).collect()} == wanted


@pytest.mark.parametrize("busy", [s.BUSY, 2])
def test_cosine_equals_the_angle_of_the_vectors(events, busy):
    rows = random_events(2)
    by_item = vectors(rows)
    wanted = {}
    for a, x in by_item.items():
        for b, y in by_item.items():
            dot = sum(x[u] * y[u] for u in x.keys() & y.keys())
            if a != b and dot:
                wanted[a, b] = dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    found = {(r.a, r.b): r.score for r in s.cosine(s.interactions(events(*rows)), busy, 3).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_recommendations_are_unseen_neighbours_best_first(events):
    rows = random_events(3, users=7, items=20, n=60)
    pairs = s.interactions(events(*rows))
    found = s.recommend(pairs, s.cosine(pairs), 4).collect()
    own = defaultdict(set)
    for user, item, _ in rows:
        own[user].add(item)
    assert found and not [r for r in found if r.product_id in own[r.user_id]]
    for user in own:
        mine = sorted((r.rank, -r.score, r.product_id) for r in found if r.user_id == user)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda m: m[1:])


def test_who_has_no_neighbours_gets_what_is_popular(spark, events):
    rows = [*random_events(4, users=3, items=5, n=40), (77, 901, "purchase")]
    pairs = s.interactions(events(*rows))
    totals = sorted(((sum(by.values()), item) for item, by in vectors(rows).items()), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.product_id) for r in s.popular(pairs, 3).collect()] == totals[:3]
    users = spark.createDataFrame([(77,), (88,), (0,)], "user_id int")
    found = s.with_fallback(users, s.recommend(pairs, s.cosine(pairs)), pairs, 3).where("user_id > 70").orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.product_id, r.origin) for r in found] == [(u, item, "popular") for u in (77, 88) for _, item in totals[:3]]


def test_wide_rows_come_back(spark):
    made = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.9), (2, 9, 0.1)], "user_id long, product_id long, score double")
    wide = sinks.wide_recommendations(made, 3)
    assert [(r.product_id, r.score) for r in sinks.read_wide(wide, 1, 3).orderBy("rank").collect()] == [(8, 0.9), (7, 0.5)]
    assert sinks.read_wide(wide, 5, 3).count() == 0


def test_split_precision_and_stored_model(spark, tmp_path):
    pairs = spark.createDataFrame([(u, p, 1.0) for u in range(12) for p in range(12) if (u + p) % 3 or u == 0] + [(99, 1, 1.0)], "user_id long, product_id long, weight double")
    train, test = als.split(pairs)
    assert train.count() + test.count() == pairs.count() and test.where("user_id = 99").count() == 0
    model = als.fit(train)
    found = als.precision(model, train, test).first()
    assert 0 <= found.precision <= 1 and found.users > 0
    assert als.precision(model, train, test.limit(0)).first().precision == 0.0
    path = f"file://{tmp_path}/model"
    als.save(model, path)
    again = als.top(als.load(path), als.eligible(pairs), 3)
    assert sorted(again.collect()) == sorted(als.top(model, als.eligible(pairs), 3).collect())
    assert als.top(model, als.eligible(pairs), 3).groupBy("user_id").count().where("count > 3").count() == 0
