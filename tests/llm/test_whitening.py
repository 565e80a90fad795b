import math

import numpy as np
import pytest

from parley.llm import whitening as w
from parley.llm.vectors import Moments, symmetric_eigen


def usable(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, d, k=16):
    """By the wording, with whole-number sums and LAPACK's eigenvectors: (vec_id, component) -> values."""
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in usable(rows, d)]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    off = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        o = np.array(v, dtype=object) * n - sums
        z = (o / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, int((o * o).sum()), z[c], values[c] / values.sum()) for c in range(k)]
    return out


def made(seed=1, n=400, d=24):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(c) for c in rng.normal(size=d) * np.linspace(4, 0.5, d)]) for k in range(n)]
    rows += [(k, rows[3][1]) for k in range(5000, 5200)] + [(None, rows[4][1]), (9, rows[9][1])]
    odd = [None, [], [1.0] * (d - 1), [float("nan"), *[1.0] * (d - 1)], [float("inf"), *[1.0] * (d - 1)], [None, *[1.0] * (d - 1)]]
    return rows + [(9000 + k, v) for k, v in enumerate(odd)]


def test_equals_brute_force(spark):
    rows, d = made(), 24
    docs = spark.createDataFrame([(i, v, 7, "z") for i, v in rows], "vec_id long, embedding array<double>, n int, y string").repartition(5)
    got = [tuple(r) for r in w.whiten(docs).collect()]
    want = brute(rows, d)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[3]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [x[:4] for x in want]
    for c in range(1, 17):
        a, b = (np.array([r[4] for r in rs if r[1] == c]) for rs in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert all(abs(g[5] - x[5]) < 1e-12 and g[6] < 1e-9 for g, x in zip(got, want, strict=True))


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert w.whiten(spark.createDataFrame([], schema)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 4, schema)).count() == 0
    line = [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]  # one component has a spread
    got = w.whiten(spark.createDataFrame(line, schema)).collect()
    assert [r["component"] for r in got] == [1] * 5 and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_huge_entries_and_deviations(spark):
    rows = [(1, [1e30, 0.0]), (2, [1e12, 0.0]), (3, [-1e12, 1.0]), (4, [0.0, 5.0])]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {2, 3, 4}  # 64e30 is no whole number of 64 bits
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {2, 3}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen_against_lapack(n):
    rng = np.random.default_rng(n)
    for rank in {1, n}:
        a = rng.normal(size=(n, rank))
        a = a @ a.T
        values, vectors = symmetric_eigen(a)
        scale = max(values.max(), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale * n
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * n
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale * n


def test_merging_equals_adding():
    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (90, 5))
    whole, parts = Moments(5), [Moments(5) for _ in range(4)]
    whole.add_all(x.astype(float), x)
    for k, part in enumerate(parts[:3]):
        part.add_all(x[30 * k : 30 * k + 30].astype(float), x[30 * k : 30 * k + 30])
    total = Moments(5)
    for part in parts:
        total.merge(part)
    assert total.n == 90 and total.sums == whole.sums == x.sum(axis=0).tolist()
    assert np.abs(total.covariance() - np.cov(x.T, bias=True)).max() < 1e-9 and np.abs(whole.m2 - total.m2).max() < 1e-8
