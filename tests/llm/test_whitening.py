import math

import numpy as np
import pytest

from quire.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, most=8):
    """numpy's own covariance and eigenvectors."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    v = (x - total / n).T @ (x - total / n) / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:most], q[:, ::-1][:, :most]
    return values, np.trace(v), (x - total / n) @ q, [sum(int(y) ** 2 for y in n * r - total) for r in x]


def by_vector(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 5).astype(np.float32)
    got = by_vector(whitening.whiten(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], SCHEMA).repartition(5)))
    values, trace, projected, deviations = plain(vectors)
    assert len(got) == 700 and all(sorted(r) == list(range(1, 9)) for r in got.values())
    for c in range(1, 9):
        z = np.array([got[k][c]["whitened"] for k in range(700)])
        want = projected[:, c - 1] / math.sqrt(values[c - 1])
        assert np.allclose(z, want, atol=1e-9) or np.allclose(z, -want, atol=1e-9)
        assert got[0][c]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
    assert [got[k][1]["deviation"] for k in range(700)] == deviations
    assert {r["n"] for x in got.values() for r in x.values()} == {700}
    assert len({r["identity_error"] for x in got.values() for r in x.values()}) == 1 and got[0][1]["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    held = [(1, [1.0, 2.0, 3.0]), (1, [2.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.5]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [1.0, nan, 2.0]), (7, [inf, 1.0, 2.0]), (None, [0.0, 1.0, 9.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame(held, SCHEMA).selectExpr("*", "vec_id as d", "vec_id as v", "vec_id as n", "vec_id as component", "vec_id as whitened")
    rows = whitening.whiten(df).collect()
    assert sorted(r["vec_id"] or -1 for r in rows) == sorted([-1] * 3 + [1] * 6 + [2] * 3 + [8] * 2 + [9] * 2)
    threes = [r for r in rows if r["vec_id"] not in (8, 9)]
    assert {r["n"] for r in threes} == {4} and all(r["identity_error"] < 1e-9 for r in threes)
    pair = [r for r in rows if r["vec_id"] in (8, 9)]  # a length of its own, without spread
    assert all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (2, 0, 0.0, 0.0, 0.0) for r in pair)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whitening_of_huge_entries(spark):
    held = [(1, [1e30, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 5.0])]
    rows = whitening.whiten(spark.createDataFrame(held, "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 6 and all(r["deviation"] is None for r in rows)
    rows = whitening.whiten(spark.createDataFrame([(k, [1e300 * k, 1.0]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert {(r["whitened"], r["explained"]) for r in rows} == {(0.0, 0.0)}


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(5)
    y = np.floor(rng.normal(size=(900, 6)) * 500)
    whole = whitening.Moments.empty(6)
    for row in y:
        whole.add(row[None])
    parts = []
    for part in np.array_split(y, 7):
        states = {}
        whitening._add(states, part)
        parts.append(states[6])
    first = whitening.Moments.empty(6)
    for k in (3, 0, 6, 1, 5, 2, 4):
        first.merge(parts[k])
    assert first.n == 900 and first.total.tolist() == (y.astype(int) + 100_000).sum(axis=0).tolist()
    assert np.allclose(first.m2, whole.m2, rtol=1e-12) and np.allclose(first.m2 / 900, np.cov(y.T, bias=True), rtol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, max(1, n // 2 + 1)))
    for v in (a @ a.T, np.diag(np.arange(n) % 3.0), np.ones((n, n)), np.zeros((n, n)), a @ a.T * 1e-200):
        values, q = whitening.eigen(v)
        size = max(np.abs(v).max(), 1e-300)
        assert np.all(np.diff(values) <= 0) and np.allclose(q.T @ q, np.eye(n), atol=1e-12)
        assert np.allclose(values / size, np.linalg.eigvalsh(v / size)[::-1], atol=1e-10 * n)
        assert np.allclose(v @ q / size, q * values / size, atol=1e-10 * n)
