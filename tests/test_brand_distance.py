"""Runs near words of trade, against a walk over each text; texts are not dealt out for it."""

import random
from collections import Counter

from parley.operators import entities as E


def walked(texts):
    found = Counter()
    for text in texts:
        k = 0
        while k < len(text):
            end = k
            while end < len(text) and text[end] in "古驰":
                end += 1
            if 2 <= end - k <= 5 and set(text[max(0, k - E.REACH) : k] + text[end : end + E.REACH]) & set(E.TRADE):
                found[text[k:end]] += 1
            k = max(end, k + 1)
    return found


def test_runs_near_trade(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("古驰买。\n\U0001f600a", weights=[6, 4, 1, 6, 4, 8, 4], k=rng.randint(0, 120))) for _ in range(300)]
    texts += ["买" + "\U0001f600" * n + "古驰" + "\U0001f600" * m + "款" for n in (11, 12, 30) for m in (11, 12, 30)]
    rows = spark.createDataFrame([*enumerate(texts), (None, "买古驰"), (999, None)], "id long, text string")
    near = E.near_trade(rows, "古驰", bounds=E.Bounds(brand_uses=1))
    assert {r["word"]: r["n"] for r in near.collect()} == walked(texts)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "hashpartitioning(id" not in plan
