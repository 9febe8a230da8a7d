"""Whitening against exact integers and a float64 decomposition."""

import math
import random

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors(seed=0, n=120, d=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2 * (k + 1)) + 0.3 for k in range(d)], 1, "clash", None) for i in range(n)]
    rows += [(500, rows[3][1], 0, "", ""), (None, rows[4][1], 0, "", ""), (7, rows[9][1], 0, "", "")] + [(600, rows[5][1], 0, "", "")] * 40
    rows += [(700, None, 1, "", ""), (701, [None] * d, 1, "", ""), (702, [float("nan")] + [0.0] * (d - 1), 1, "", ""), (703, [math.inf] * d, 1, "", ""), (704, [], 1, "", ""), (705, [1.0], 1, "", "")]
    return rows


def brute(rows, d):
    kept = [(i, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, v, *_ in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[k] for x in fit) for k in range(d)]
    u = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    v = u.T @ u / n
    values, q = np.linalg.eigh(v)
    return kept, n, sums, v, values[::-1], q[:, ::-1]


def test_whiten(spark):
    from tidewarden.llm.whitening import whiten

    rows, d = vectors(), 6
    kept, n, sums, v, values, q = brute(rows, d)
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    deviation = sorted(((i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept for _ in range(4)))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got) == deviation
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, 5):
        mine = {r.vec_id: r.whitened for r in got if r.component == c}
        expected = {i: float((np.array(x) - np.array(sums) / n) @ q[:, c - 1] / math.sqrt(values[c - 1])) for i, x in kept}
        sign = 1 if mine[0] * expected[0] > 0 else -1
        assert all(abs(mine[i] * sign - w) < 1e-10 for i, w in expected.items() if i != 7)
        (share,) = {r.explained for r in got if r.component == c}
        assert share == pytest.approx(values[c - 1] / v.trace(), rel=1e-12)


def test_degenerate_tables(spark):
    from tidewarden.llm.whitening import whiten

    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0 and whiten(empty).columns[0] == "vec_id"
    assert whiten(spark.createDataFrame([(1, None, 1, "", ""), (2, [], 1, "", "")], SCHEMA)).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "", "")] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whiten(spark.createDataFrame([(k, [float(k), 1.0, 0.0], 1, "", "") for k in range(5)], SCHEMA)).collect()
    assert [r.explained for r in line if r.vec_id == 0] == [1.0, 0.0, 0.0] and all((r.whitened is None) == (r.component > 1) for r in line)
    huge = whiten(spark.createDataFrame([(1, [1e14, 0.0], 1, "", ""), (2, [-1e14, 1.0], 1, "", ""), (3, [3e38, 1.0], 1, "", "")], SCHEMA)).collect()
    assert {r.vec_id for r in huge} == {1, 2} and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-12 for r in huge if r.component == 1)


def test_exact_products():
    from tidewarden.llm.whitening import product

    rng = np.random.default_rng(1)
    for bits in (3, 19, 21, 45, 58):
        y = rng.integers(-(1 << bits), 1 << bits, (37, 3))
        exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert product(y).tolist() == exact


@pytest.mark.parametrize("values", [np.arange(1.0, 13), np.array([1, 1 + 1e-9, 1 + 2e-9, 1 + 5e-7, 2, 2, 2 + 1e-12, 5, 5.00001, 7, 7, 1e-9]), np.ones(12), np.array([1e6, 1e6 + 1e-4, 1, 1 + 1e-10, *[0.0] * 8])])
def test_refinement_of_clusters(values):
    """Float32 eigenvectors become orthogonal and diagonal far beyond float32, and beyond float64 where the platform allows."""
    from tidewarden.llm.whitening import HIGH, refine

    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(HIGH)
    for _ in range(3):
        q = q @ (1.5 * np.eye(12, dtype=HIGH) - 0.5 * q.T @ q)
    a = q @ np.diag(values.astype(HIGH)) @ q.T
    a = (a + a.T) / 2
    got, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    size = float(np.abs(a).max())
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-17 * 60 and np.abs(a @ x - x * got).max() < size * 1e-17 * 60
    assert np.abs(got - np.sort(values.astype(HIGH))).max() < size * 1e-16
    # each eigenvector that stands apart by more than the precision is the right one
    order = np.argsort(values, kind="stable")
    for k in range(12):
        gap = min(abs(values[order[k]] - v) for j, v in enumerate(values) if j != order[k])
        if gap > 1e-10 * size:
            assert abs(abs(float(q[:, order[k]] @ x[:, k])) - 1) < 1e-12
