from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from parley.llm import decontamination, jaccard_join, mixing, pii, quality
from parley.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(c.STAGES):
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == columns
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before)
        if name == "quality":
            scores = quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert set(after) == {r["doc_id"] for r in scores.collect() if r["quality_score"] >= quality.KEEP_AT}
            assert 0 < len(after) < len(before)
        if name == "near_duplicates":
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, (r["text"] or "").split()) for i, r in before.items())}
            gone = set(before) - set(after)
            assert gone and all(any(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in before if j != i) for i in gone)
            kept = sorted(after)
            assert not any(sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i in kept for j in kept if i < j)
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            leaks = [r["text"] for r in items.collect()]
            assert not any(t in (r["text"] or "") for t in leaks for r in after.values())
            assert set(before) - set(after) == {r["doc_id"] for r in decontamination.contaminated(docs, items).collect()}
        if name == "pii":
            assert set(after) == set(before)
            assert not any(pii.base_spans(r["text"] or "") for r in after.values())
            changed = [i for i in after if after[i] != before[i]]
            assert all(after[i]["n_chars"] == len(after[i]["text"]) and "[" in after[i]["text"] for i in changed)
        if name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["size"]}
            assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({i: n for i, n in want.items() if n})
        docs = out
    assert c.run(spark, SF).exceptAll(docs).count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, node string"
    rows = [(1, None, None, None, None, 1, "a", None), (2, "", "en", "s", 0, 1, "a", "x"), (None, None, None, None, None, None, None, None), (None, "words of no id", "en", "s", 14, 1, "a", "x")]
    rows += [(3, "mail a@b.cd " * 8000, "en", "s", 9, 1, "a", "x")] * 2
    docs = spark.createDataFrame(rows, schema)
    for at in (docs, docs.where("false")):
        for name, stage in c.STAGES:
            out = stage(spark, at, SF)
            assert out.columns == docs.columns
            if name == "near_duplicates":  # one row of each text, whatever repeats
                assert out.count() == (3 if at is docs else 0)
            elif name == "mixing":  # nothing without words is taken, and rows without id have a coin of their text
                assert all(r["text"] for r in out.collect())
            else:
                out.agg(F.count("*")).collect()
