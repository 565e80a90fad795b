import math

import numpy as np
import pyarrow as pa

from parley.llm import quality
from parley.llm.words import Words, utf8

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"), sample=500)
    told = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good, kept = told["quality"] == 1, told["quality_score"] >= quality.KEEP_AT
    assert (good & kept).sum() / good.sum() > 0.99
    assert (~good & ~kept).sum() / (~good).sum() > 0.9


def test_views_teach_each_other():
    # the metadata decide, and the text follows them but for rows that it cannot tell; few labels
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    meta = np.zeros((2000, 8))
    meta[np.arange(2000), 4 * y + rng.integers(0, 4, 2000)] = 1
    text = np.column_stack([2.0 * y + rng.normal(size=2000), rng.normal(size=2000)])
    free_text, free_meta = text[60:1000], meta[60:1000]

    def ask(views):
        told = []
        for k, x in enumerate((free_text, free_meta)):
            p = quality.sigmoid(views[k].logit(x))
            sure = np.flatnonzero((p >= 0.9) | (p <= 0.1))
            told.append((quality.Rows(free_text[sure], free_meta[sure], (p[sure] >= 0.9).astype(float)), int((p >= 0.9).sum()), int((p <= 0.1).sum())))
        return told

    model = quality.co_train(quality.Rows(text[:60], meta[:60], y[:60].astype(float)), ask)
    assert any(ones + zeros for _, _, ones, zeros in model.handed)
    assert ((model.score(text[1000:], meta[1000:]) >= 0.5) == y[1000:]).mean() > 0.97


def test_the_exchange_covers_all_documents_and_repeats(spark):
    """What a view is sure of equals a plain computation over every unlabelled row, and two fits are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one, two = (quality.train(d, labels) for d in (docs, docs.repartition(7).unionAll(docs.limit(50))))
    assert (one.blend == two.blend).all()  # repeated rows count once, and partitions do not matter
    rows = quality.featured(docs).toPandas()
    found = quality.sure_of(quality.featured(docs), [one.text, one.meta], 0.9).groupBy("view", "label").count().collect()
    want = {}
    for k, x in enumerate((np.array(rows["features"].tolist()), quality.one_hot(np.array(rows["slots"].tolist())))):
        p = quality.sigmoid((one.text, one.meta)[k].logit(x))
        want |= {(k, 1): int((p >= 0.9).sum()), (k, 0): int((1 - p >= 0.9).sum())}
    assert {(r["view"], r["label"]): r["count"] for r in found} == {k: n for k, n in want.items() if n}


def test_scores_by_brute_force(spark):
    """Each score equals the blend of both views, taken one row at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        x = quality.text_features(Words(*utf8(pa.array([r["text"]], pa.large_string())))).astype(np.float32).astype(float)[0]
        slots = quality.meta_slots(r["source"], r["lang"], r["n_chars"])
        logits = []
        for view, row in ((model.text, x), (model.meta, quality.one_hot(np.array([slots]))[0])):
            raw = sum(w * min(8, max(-8, (v - c) / s)) for w, v, c, s in zip(view.weights, row, view.centre, view.scale)) + view.weights[-1]
            logits.append(min(12, max(-12, raw)) * view.curve[0] + view.curve[1])
        want = 1 / (1 + math.exp(-(logits[0] * model.blend[0] + logits[1] * model.blend[1] + model.blend[2])))
        assert abs(got[r["doc_id"]] - want) < 1e-9


def test_edges(spark):
    good = [(k, f"Some plain words stand here, number {k} of them. And a second sentence follows.", f"s{k % 3}", "en", 60) for k in range(40)]
    bad = [(100 + k, "BUY!! NOW!! " * (k + 3), f"s{k % 3}", "en", 60) for k in range(40)]
    odd = [(200, None, None, None, None), (201, "", "s0", "en", 0), (202, "word " * 100000, "s1", "xx", -5), (0, good[0][1], "s0", "en", 60)]
    docs = spark.createDataFrame([(*r, 1) for r in good + bad + odd], "doc_id long, text string, source string, lang string, n_chars long, quality int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)] + [(0, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    plain = docs.drop("quality")
    model = quality.train(plain, labels)
    scored = quality.score(docs, model)
    assert quality.score(scored, model).columns == scored.columns
    assert scored.columns == [*docs.columns, "quality_score"] and scored.count() == len(good + bad + odd)
    kept = {r["doc_id"] for r in quality.accepted(plain, labels).collect()}
    assert len(kept & set(range(40))) >= 38 and not kept & set(range(100, 140))
    assert quality.train(plain, labels.where("quality = 1")) is None
    assert {r["quality_score"] for r in quality.score(plain, None).collect()} == {1.0}
    assert quality.score(plain.where("false"), model).count() == 0
