import zlib

import numpy as np
from pyspark.sql import functions as F

from parley.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(*toxicity.training_rows(docs.select("doc_id", "text"), labels, 300))
    scored = toxicity.score_texts(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).toPandas()
    told, true = scored["score"] >= toxicity.TOXIC_AT, scored["toxic"] == 1
    assert (told & true).sum() / true.sum() > 0.8
    assert (told & ~true).sum() / (~true).sum() < 0.02


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"word{i} here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    texts, toxic, _ = toxicity.training_rows(docs, labels)
    ids = {int(t.split()[0][4:]) for t in texts}
    assert ids == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(toxic[k] == int(t.split()[0][4:]) % 2 for k, t in enumerate(texts))


def test_edges(spark):
    clean = ["the cat sat on the mat again", "a dog ran over some hill", "plain words only in this one", "no harm in it at all"]
    places = [(c.split(), k) for k, c in enumerate(clean * 3)]
    texts = [" ".join([*w[: k % 6], "zork", *w[k % 6 :]]) for w, k in places] + [" ".join(w) + f" {k}" for w, k in places]
    model = toxicity.fit(texts, np.repeat([1, 0], 12))
    rows = [(1, None, "x"), (2, "", "x"), (3, "you ZORK!! zork", "x"), (4, "é zork", "x"), (4, "é zork", "x"), (5, "word " * 30000 + "zork", "x"), (6, "fine", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r["doc_id"]): r for r in toxicity.score_texts(docs, model).collect()}
    assert got[1]["score"] == got[2]["score"] < toxicity.TOXIC_AT
    assert [(s["start"], s["end"]) for s in got[3]["offending"]] == [(4, 8), (11, 15)]
    assert [(s["start"], s["end"]) for s in got[4]["offending"]] == [(2, 6)]
    assert got[5]["n_toxic_tokens"] == 1
    assert toxicity.score_texts(docs.where("false"), model).count() == 0
    assert {r["score"] for r in toxicity.score_texts(docs, None).collect()} == {0.0}
    assert toxicity.score_texts(docs, model).count() == len(rows)
