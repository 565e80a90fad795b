"""Pairs of skeletons by blocks against one by one, whatever their lengths."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import aliases as A
from test_aliases import edits

SIZES = (2, 3, 5, 7, 8, 15, 16, 17, 31, 33, 63, 64, 65, 90)


@pytest.mark.parametrize("longest", (16, 32, 64, 90))
def test_distances(longest):
    rng = random.Random(longest)
    word = lambda: "".join(rng.choices("pfts", k=rng.choice([n for n in SIZES if n <= longest])))
    held = [word() for _ in range(60)]
    held += [s[:k] + rng.choice("pk") + s[k + 1 :] for s in held for k in [rng.randrange(len(s))]]
    block = A.Block(held, A.SIMILAR)
    for s in sorted({word() for _ in range(20)} | set(held[:20])):
        which, found = block.near(s)
        want = {k: edits(s, x) for k, x in enumerate(held)}
        assert dict(zip(which.tolist(), found.tolist())) == {k: d for k, d in want.items() if d <= A.most_edits(len(s), len(held[k]))}
    assert not len(A.Block([], A.SIMILAR).near("pt")[0])


def test_no_pair_of_alike_skeletons_leaves_a_block(spark, monkeypatch):
    """Suggestions of many blocks are those of all pairs, and the plan makes no row for a pair."""
    monkeypatch.setattr(A, "STEPPED", 9)
    monkeypatch.setattr(A, "HELD", 20)
    rng = random.Random(5)
    rows = [(f"{side}{k}", rng.randint(1, 9), side, "".join(rng.choices("pft", k=rng.randint(1, 6)))) for side, n in (("han", 40), ("latin", 90)) for k in range(n)]
    words = spark.createDataFrame(rows, "word string, n long, side string, skeleton string")
    groups = words.select("word", (F.col("n") % 4).cast("string").alias("group"))
    pairs = {(r["a"], r["b"]): r["similarity"] for r in A.alike(words.where("side = 'han'"), words.where("side = 'latin'")).collect()}
    similar = lambda x, y: 1 - edits(x, y) / max(len(x), len(y))
    long = [r for r in rows if len(r[3]) > 1]
    assert pairs == {(x[3], y[3]): round(similar(x[3], y[3]), 6) for x in long for y in long if x[2] == "han" and y[2] == "latin" and similar(x[3], y[3]) >= A.SIMILAR}
    want = {}
    for x in rows:
        for y in rows:
            heard = x[2] != y[2] and len(x[3]) > 1 and len(y[3]) > 1 and similar(x[3], y[3]) >= A.SIMILAR
            score = A.TOGETHER * (x[1] % 4 == y[1] % 4) + (A.SOUND * round(similar(x[3], y[3]), 6) if heard else 0)
            if x != y and score > A.ENOUGH:
                want[x[0]] = min(want.get(x[0], (0,)), (-round(score, 6), -y[1], y[0]))
    suggested = A.suggestions(words, groups)
    assert {r["word"]: (r["suggested"], r["score"]) for r in suggested.collect()} == {w: (b, -s) for w, (s, _, b) in want.items()}
    plan = suggested._jdf.queryExecution().analyzed().toString()
    assert "mate_skeleton" not in plan and "levenshtein" not in plan
