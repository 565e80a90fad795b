import random

import numpy as np

from parley.llm import jaccard_join as j


def brute(rows):
    sets, texts = {}, {}
    for i, t in rows:
        texts[i] = t or ""
        w = texts[i].split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    rep = {}
    for i in sorted(texts):
        rep.setdefault(texts[i], i)
    reps = sorted(rep.values())
    links = {i: set() for i in reps}
    for a in reps:
        for b in reps:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    group = {i: i for i in reps}
    changed = True
    while changed:
        changed = False
        for a in reps:
            least = min([group[a], *(group[b] for b in links[a])])
            if least < group[a]:
                group[a], changed = least, True
    return sorted((i, group[rep[t]], rep[t], len(links[rep[t]])) for i, t in texts.items())


def made(seed, families=12, members=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rows += rows[:10] + ["", None, "one", "one two", "two one", "one two", " "]
    rng.shuffle(rows)
    return [(k * 2 + 1, t) for k, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = made(1)
    docs = spark.createDataFrame([(*r, 0) for r in [*rows, rows[0], rows[7]]], "doc_id long, text string, root long")
    want = brute(rows)
    assert sum(w[3] for w in want) > 100
    for limits in ((4, 8 << 20, 8), (512, 2000, 1), (512, 8 << 20, 8)):  # blocks by members and by bytes, cells made one
        assert sorted(tuple(r) for r in j.join(docs, *limits).collect()) == want
    kept = sorted(r["doc_id"] for r in j.deduplicated(docs).collect())
    assert kept == sorted(w[0] for w in want if w[0] == w[1])


def test_rows_without_id_and_columns_of_any_name(spark):
    long = " ".join(f"w{k % 977}" for k in range(60000))
    rows = [(1, "a b c d e f", 1, 1, "x"), (None, "a b c d e f", 2, 2, "x"), (None, "only here and nowhere else", 3, 3, None), (None, "only here and nowhere else", 3, 3, None), (None, None, 4, 4, None), (5, long, 5, 5, None), (6, long + " end", 6, 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, tied int, node string")
    got = [tuple(r) for r in j.join(docs).collect()]
    assert {r for r in got if r[0]} == {(1, 1, 1, 0), (5, 5, 5, 1), (6, 5, 6, 1)}
    unnamed = [r for r in got if r[0] is None]
    assert len(unnamed) == 3 and sum(r[1] == 1 for r in unnamed) == 1 and all(r[1] == 1 or r[1] >= j.UNNAMED for r in unnamed)
    kept = j.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["n"]) for r in kept.collect()) == [(0, 3), (0, 4), (1, 1), (5, 5)]


def test_met_deals_no_hot_key(spark, monkeypatch):
    monkeypatch.setattr(j, "SHARE", 3)
    rows = spark.createDataFrame([(k % 4 if k < 20 else 9, k) for k in range(100)], "key long, x long")
    facts = rows.groupBy("key").count().withColumnRenamed("count", "n").where("key != 2")
    for how in ("inner", "left"):
        got = {(r["x"], r["n"]) for r in j.met(rows, facts, ["key"], 100, how).collect()}
        assert got == {(r["x"], r["n"]) for r in rows.join(facts, "key", how).collect()}


def test_rows_of_cold_keys_pass_one_join(spark, monkeypatch):
    monkeypatch.setattr(j, "SHARE", 3)
    rows = spark.createDataFrame([(k if k < 40 else 99, k % 2, k) for k in range(100)], "key long, other int, x long")
    facts = rows.groupBy("key", "other").count().withColumnRenamed("count", "n")
    found = j.met(rows, facts, ["key", "other"], 100)
    assert sorted((r["x"], r["n"]) for r in found.collect()) == [(k, 1 if k < 40 else 30) for k in range(100)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 + (plan.count("Union") == 1) and "Join LeftOuter" not in plan


def test_empty(spark):
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior():
    # by numerical integration of the posterior
    x = np.linspace(0, 1, 200001)
    for n in (20, 100):
        floor = j.least_agreements()[n]
        for m, keeps in ((floor, True), (floor - 1, False)):
            if m >= 0:
                d = x**m * (1 - x) ** (n - m)
                assert (d[x >= j.AT].sum() / d.sum() >= j.TOLERANCE) == keeps


def test_common_by_products():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 200).astype(np.uint64)) for _ in range(20)]
    i, k = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20)))
    assert j.common(sets, sets, i, k).tolist() == [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, k)]
