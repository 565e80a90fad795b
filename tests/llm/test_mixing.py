from parley.llm import mixing


def level_by_rounds(sizes, cap=3):
    """Targets by dealing the excess again until none is above, as the wording has it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if want[s] > cap * sizes[s] + 1e-9]
        if not above:
            return fixed | want
        fixed |= {s: cap * sizes[s] for s in above}


def test_targets_and_copies(spark):
    rows, n = [], 0
    for source, docs, words in (("a", 3, 5), ("b", 200, 9), (None, 40, 30), ("c", 10, 2), ("é", 60, 7), ("Z", 1, 1)):
        for k in range(docs):
            rows.append((n, source, "w " * (words + k % 3), 7))
            n += 1
    rows += [(n, "a", None, 7), (n + 1, "b", "", 7), (0, "a", rows[0][2], 7), (n + 2, "none", "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken_by long")
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = level_by_rounds(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 12 for s in sizes)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mixed_rows(docs).count() == sum(r["copies"] for r in got if r["size"])
    assert mixing.mix(docs.where("false")).count() == 0


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "s", "a b", 5.0, "x"), (2, "s", "c", 5.0, "x")], "doc_id long, source string, text string, target double, size string")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and {(r["target"], r["size"]) for r in out.collect()} == {(5.0, "x")}


def test_null_ids_are_dealt(spark):
    rows = [(None, "a", f"some words {k}") for k in range(60)] + [(k, "b", f"other words {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len(got) == 80 and all(r["copies"] is not None and r["taken"] == r["copies"] * r["size"] for r in got)
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "a")) <= 9
    assert mixing.mixed_rows(docs).where("source = 'a'").count() == sum(r["copies"] for r in got if r["source"] == "a")
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
