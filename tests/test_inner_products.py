import numpy as np
import pytest

from millrace.operators import als
from millrace.operators import inner_products as ip


def made(seed, n, dimensions=6, spread=1.0):
    """Vectors of lengths far apart, some of them twice, some of them nothing."""
    rng = np.random.default_rng(seed)
    found = rng.normal(size=(n, dimensions)) * np.exp(rng.normal(size=(n, 1)) * spread)
    found[: n // 10] = found[n // 10 : 2 * (n // 10)]
    found[-(n // 20) :] = 0
    return rng.permutation(found).astype(np.float32)


def brute(queries, others, n):
    """Ids of the best of each query, ties by id; ids are places."""
    products = (queries.astype(float)[:, None, :] * others).sum(axis=2)
    return [np.lexsort((np.arange(len(others)), -row))[:n].tolist() for row in products], products


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, features array<float>")


@pytest.mark.parametrize(("n", "sign", "together"), [(1, 1, 64), (10, 1, 8192), (10, -1, 64), (700, 1, 8192)])
def test_best_equals_brute_force(spark, monkeypatch, n, sign, together):
    monkeypatch.setattr(ip, "TOGETHER", together)
    monkeypatch.setattr(ip, "LONGEST", 40)
    queries, others = made(1, 200), made(2, 600)
    if sign < 0:  # no product above zero, so that lengths tell nothing
        queries, others = np.abs(queries), -np.abs(others)
    wanted, products = brute(queries, others, n)
    found = ip.best(frame(spark, queries), frame(spark, others), n).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query, -r.score, r.id)):
        by.setdefault(r.query, []).append(r)
    assert [[r.id for r in by[i]] for i in range(200)] == wanted
    assert all(r.score == pytest.approx(products[r.query, r.id], abs=1e-12) for r in found)


def test_equal_needs_share_groups_and_no_bound_exceeds_a_need():
    bounds = [-1.0, 0.5, 0.5, 2.0]
    need = np.array([-1.0] * 6 + [0.5] * 6 + [1.0, 2.0, 3.0])
    batch = ip.pa.RecordBatch.from_pydict({"id": np.arange(15), "features": [[1.0]] * 15, "need": need})
    group = next(ip._dealt(bounds[1:])([batch])).column("group").to_numpy()
    assert set(group[6:12]) == {0, 1, 2} and all(bounds[g] <= x for g, x in zip(group, need, strict=True)) and group[12:].tolist() == [2, 3, 3]


def test_no_others_or_queries_give_nothing(spark):
    some, no = frame(spark, made(1, 40)), frame(spark, made(1, 40)[:0])
    assert ip.best(some, no, 3).count() == 0 and ip.best(no, some, 3).count() == 0


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_steps_make_no_difference_and_end_early(monkeypatch, step):
    monkeypatch.setattr(ip, "FIRST", step)
    monkeypatch.setattr(ip, "MOST", max(step, 64))
    monkeypatch.setattr(ip, "ROWS", 16)
    queries, others = made(3, 50), made(4, 3000, spread=2.0)
    order = np.lexsort((np.arange(3000), -ip._lengths(others)))
    best = ip._Best(np.arange(50), queries, 5)
    for part in np.array_split(order, 9):
        best.meet(part, others[part])
    nothing = ip._lengths(queries) == 0
    wanted = brute(queries, others, 5)[0]
    assert [x.tolist() for x, no in zip(best.found, nothing, strict=True) if not no] == [x for x, no in zip(wanted, nothing, strict=True) if not no]
    best = ip._Best(np.arange(int((~nothing).sum())), queries[~nothing], 5)
    best.meet(order, others[order])
    assert not len(best.open) or step == 4096
    assert step == 4096 or best.seen < 1500


def test_top_is_what_the_model_recommends(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(u, p, float(1 + (u * p) % 7)) for u in range(60) for p in rng.choice(90, 12, replace=False).tolist()], "user_id long, product_id long, weight double")
    model, users = als.fit(pairs), als.eligible(pairs)
    wanted = {(r.user_id, x.product_id): x.rating for r in model.recommendForAllUsers(4).collect() for x in r.recommendations}
    found = {(r.user_id, r.product_id): r.score for r in als.top(model, users, 4).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], rel=1e-5) for k in wanted)
