import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import hard_negatives as h


def brute(rows, every, scale=256, d=None):
    """By the wording, over all pairs."""
    rows = [(i, n, [math.floor(scale * float(c)) for c in v]) for i, n, v in rows if i is not None and n is not None and v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, _, v in rows], dtype=object).reshape(len(rows), d)
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i % every:
            continue
        scores = x @ x[a]
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-scores[k], rows[k][0]))
        for p in [k for k in order if rows[k][1] == label][:5]:
            fit = [k for k in order if rows[k][1] != label and 50 * scores[p] <= 100 * scores[k] <= 95 * scores[p]][:3]
            out += [(i, rows[p][0], r + 1, rows[k][0], int(scores[p]), int(scores[k])) for r, k in enumerate(fit)]
    return sorted(out)


def made(seed, n=700, d=12, labels=4, tight=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for k in range(n):
        v = rng.normal(size=d) * (tight or 1.0) + (centres[k % 6] if tight else 0)
        rows.append((k, int(rng.integers(labels)), [float(c) for c in v]))
    rows += [(2000 + k, k % labels, rows[8][2]) for k in range(300)]  # one vector has a third of the rows
    rows += [(40, 1, rows[40][2]), (80, 0, rows[3][2]), (3000, 9, rows[5][2]), (3020, 0, [0.0] * d)]
    odd = [None, [], [1.0], [float("nan"), *[1.0] * (d - 1)], [None, *[1.0] * (d - 1)]]
    return rows + [(4000 + 20 * k, 1, v) for k, v in enumerate(odd)] + [(None, 1, rows[0][2]), (5000, None, rows[0][2])]


def run(spark, rows, every=20, kind="double"):
    df = spark.createDataFrame([(*r, "z") for r in rows], f"vec_id long, label int, embedding array<{kind}>, anchor string").repartition(3)
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("tight", [0.0, 0.2])
def test_equals_all_pairs(spark, monkeypatch, tight):
    for name, value in (("BLOCK", 64), ("GROUP", 16), ("PIVOTS", 5)):
        monkeypatch.setattr(h, name, value)
    rows = made(1, tight=tight)
    assert run(spark, rows) == brute(rows, 20, d=12)


def test_large_numbers(spark):
    for factor in (2.0**8, 2.0**19):  # sums beyond single, then beyond double precision
        rows = [(i, n, v and [c * factor if c is not None else c for c in v]) for i, n, v in made(2, 150)]
        assert run(spark, rows) == brute(rows, 20, d=12)


def test_clustered_vectors_leave_most_slices_out(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 32)
    monkeypatch.setattr(h, "GROUP", 8)
    met, kept = [], h._meeting
    monkeypatch.setattr(h, "_meeting", lambda a, b: (met.append((kept(a, b).count(), b.count(), a)), kept(a, b))[1])
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 20
    rows = [(k, k % 32, [float(c) for c in centres[k % 16] + rng.normal(size=8) * 0.1]) for k in range(1600)]
    assert run(spark, rows) == brute(rows, 20, d=8)
    groups = 1600 // 20 // 8
    assert met[1][0] < 0.8 * groups * met[1][1]  # the second scan of the positives


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, 1, None), (40, None, [1.0])]) == []
    assert run(spark, [(20, 1, [1.0])]) == []
