import math

import numpy as np
import pytest
from factloom.llm import whitening as w


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


@pytest.mark.parametrize(("rank", "dims"), [(12, 12), (5, 12), (3, 3), (1, 1)])
def test_against_numpy(spark, rank, dims):
    rng = np.random.default_rng(rank)
    vectors = (rng.normal(size=(300, rank)) * np.arange(1, rank + 1)) @ rng.normal(size=(rank, dims)) + 50
    if rank < dims:  # whole entries, so that the rank survives the floor
        vectors = np.round(vectors[:, :1]) * np.ones((1, dims)) * np.arange(1, dims + 1) if rank == 1 else np.round(rng.normal(size=(300, rank)) * 9) @ np.round(rng.normal(size=(rank, dims)) * 3)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = w.whiten(frame(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    shown = min(8, dims)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors.tolist()], object)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    assert found["component"].tolist() == list(range(1, shown + 1)) * n and set(found["n"]) == {n}
    assert found["deviation"].tolist() == np.repeat([int(d) for d in ((n * x - s) ** 2).sum(axis=1)], shown).tolist()
    white = found["whitened"].to_numpy(float).reshape(n, shown)
    has = min(rank, shown)
    assert np.allclose(found["explained"].to_numpy(float)[:shown], np.maximum(e[:shown], 0) / v.trace(), rtol=1e-9, atol=1e-12)
    for k in range(has):
        want = y @ axes[:, k] / math.sqrt(e[k])
        assert np.allclose(np.abs(white[:, k] @ want) / n, 1, atol=1e-9)
    assert np.isnan(white[:, has:]).all()
    assert np.abs(np.cov(white[:, :has].T, bias=True).reshape(has, has) - np.eye(has)).max() < 1e-9 and found["identity_error"].max() < 1e-9


def test_factors():
    rng = np.random.default_rng(3)
    for n, r in ((9, 9), (10, 4), (1, 1), (7, 0)):
        a = rng.normal(size=(n, r))
        a = a @ a.T
        low, order = w.pivoted_cholesky(a)
        assert low.shape == (n, r) and np.allclose(low @ low.T, a[np.ix_(order, order)]) and np.allclose(np.triu(low[:r], 1), 0)
        size, axes = w.principal(a)
        assert np.allclose(size, np.linalg.eigvalsh(a)[::-1][:r]) and np.allclose(axes @ axes.T, np.eye(r)) and np.allclose(axes.T * size @ axes, a)


def test_equal_eigenvalues_and_graded_ones():
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 6)))
    for e in ([4.0, 4, 4, 1, 1, 0.5], [1e6, 1e3, 1, 1e-1, 1e-2, 1e-3]):
        size, axes = w.principal(q * e @ q.T)
        assert np.allclose(size[:3], e[:3]) and np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-12)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0]), (4, None), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [])]
    found = w.whiten(frame(spark, rows)).toPandas()
    assert len(found) == 8 and set(found["n"]) == {4} and found["identity_error"].max() < 1e-12
    same = w.whiten(frame(spark, [(1, [2.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    assert w.whiten(frame(spark, [(1, [])])).collect() == []
    large = w.whiten(frame(spark, [(1, [1e9, 0.0]), (2, [-1e9, 0.0])])).collect()
    assert all(r.deviation is None and r.distance == (1024e9) ** 2 for r in large)
    assert {r.whitened for r in large if r.component == 1} == {1.0, -1.0} and all(r.whitened is None for r in large if r.component == 2)
