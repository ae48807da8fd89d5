import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.whitening import Fit, shifted_factor, solved, whiten


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "own") for i, v in rows], "vec_id long, embedding array<float>, n string")


def brute(rows, scale=256, components=4):
    """The contract by numpy: covariance of the distinct whole vectors, its eigenvectors and shares."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(float(np.float32(c)) * scale)) for c in v] + [0] * (d - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    order = np.argsort(-values)[:components]
    white = (x - s / n) @ axes[:, order] / np.sqrt(values[order])
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), white, values[order] / values.sum()


def agrees(spark, rows):
    got = whiten(frame(spark, rows), Scratch(spark, "t")).collect()
    ids, n, deviation, white, shares = brute(rows)
    k = min(4, white.shape[1])
    assert len(got) == k * len(ids)
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, {})[r.component] = r
    assert max(r.identity_error for r in got) < 1e-10 and {r.n for r in got} == {n}
    for c in range(k):
        a, b = np.array([mine[i][c + 1].whitened for i in ids]), white[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert [mine[i][c + 1].deviation for i in ids] == deviation.tolist()
        assert abs(mine[ids[0]][c + 1].explained - shares[c]) < 1e-10


def test_against_numpy_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(300, 12)) @ np.diag([9, 7, 5, 3, 1, 1, 0.5, 0.5, 0.2, 0.2, 0.1, 0.1]) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(spread)] + [(1000 + i, spread[0].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [-0.0] * 12)]
    agrees(spark, rows)


def test_badly_conditioned_and_short_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 3)) * 1000
    rows = [(i, [*v, v[0], 7.0, v[1] / 250][: 6 if i % 9 else 5]) for i, v in enumerate(base.tolist())]
    agrees(spark, rows)


@pytest.mark.parametrize("scales", [[1, 1, 1], [1e8, 1, 1e-3], [1, 0, 1]])
def test_factors_reproduce_the_rows(scales):
    """Q R is the matrix, and Q is orthonormal wherever the matrix has extent."""
    a = np.random.default_rng(7).normal(size=(500, 3)) @ np.diag(scales)
    factors, r, q = [], np.eye(3), a
    for _ in range(4):
        factors.append(shifted_factor(q.T @ q, len(a)))
        r, q = factors[-1] @ r, solved(factors, a)
    assert np.allclose(q @ r, a, rtol=1e-10, atol=1e-9)
    assert all(abs((q[:, i] ** 2).sum() - 1) < 1e-9 for i, s in enumerate(scales) if s)


def test_nothing_to_whiten(spark):
    assert whiten(frame(spark, []), Scratch(spark, "t")).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)]), Scratch(spark, "t")).count() == 0
    assert whiten(frame(spark, [(1, []), (2, [])]), Scratch(spark, "t")).count() == 0


def test_fewer_components_than_asked_and_repeated_ids(spark):
    rows = [(None, [1.0, 5.0]), (None, [2.0, 5.0]), (3, [4.0, 5.0]), (3, [4.0, 5.0])]
    got = whiten(frame(spark, rows), Scratch(spark, "t"))
    assert [tuple(r) for r in got.groupBy("vec_id").agg(F.count("*"), F.max("component")).orderBy("vec_id").collect()] == [(None, 2, 1), (3, 2, 1)]


def test_sums_beyond_a_long_stay_exact():
    fit = Fit(3, (3 << 62, 0))
    x = np.array([[1 << 62, 5], [0, 1]])
    assert fit.spread(x).tolist() == [[0, 15], [-(3 << 62), 3]]
    assert fit.deviations(x) == [225, None]
    assert Fit(2, (10, 4)).deviations(np.array([[7, 1]])) == [16 + 4]
