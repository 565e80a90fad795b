import json

from pyspark.sql import functions as F

from parley.operators import assist, names, phrases


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_chunks(spark):
    got = texts_of(spark, "one two, three  four 龙城a b").select(phrases.chunks(F.col("text")).alias("c")).first()["c"]
    assert got == [["one", "two"], ["three"], ["four", "龙", "城", "a", "b"]]


def test_discover_and_merge(spark):
    texts = texts_of(spark, *["他到龙城去", "龙城的门", "看龙城吧", "龙城 很大", "城里"])
    tokens = phrases.token_table(texts)
    found = {r["phrase"]: r["n"] for r in phrases.discover(tokens, ["的"]).collect()}
    assert found == {"龙城": 4}
    assert {r["phrase"] for r in phrases.discover(tokens, ["的"], freedom=True).collect()} == {"龙城"}
    empty = spark.createDataFrame([], "word string")
    words = phrases.lexicon(spark.createDataFrame([("龙城",)], "word string"), spark.createDataFrame([("New York City",), ("New York",)], "word string"), empty, spark.createDataFrame([("new york city",)], "word string"))
    merged = phrases.merge(texts_of(spark, "in new York City 龙城 now", None), words).orderBy("id").collect()
    assert merged[0]["tokens"] == ["in", "new York", "City", "龙城", "now"] and merged[1]["tokens"] == []


def test_names_and_short_forms(spark):
    texts = texts_of(spark, *["then Anna Karlson came and Karlson sat", "so Anna saw the Karlson house", "with Anna Karlson and Karlson again", "Today we say Anna Karlson was Karlson"], "today rose")
    found = {r["name"]: r["n"] for r in names.english_names(texts).collect()}
    assert found["Anna Karlson"] == 3 and found["Karlson"] == 7 and "Today" not in found
    full = spark.createDataFrame([("Anna Karlson", 3)], "full string, n long")
    assert {(r["alias"], r["n"]) for r in names.coreference(texts, full).collect()} == {("Karlson", 4)}


def test_model_steps(spark):
    text = "One two. Three four! " * 50
    assert "".join(assist.chunk_text(text, 40)) == text and max(map(len, assist.chunk_text(text + "x" * 100, 40))) <= 40
    assert assist.json_array('sure: ["a", "b"] done') == ["a", "b"] and assist.json_array("none [1]") is None
    texts = texts_of(spark, "ab cd", "zz")
    good = assist.segment(texts, lambda t: json.dumps(t.split()) if "zz" not in t else "no").orderBy("id").collect()
    assert [(r["tokens"], r["failed"]) for r in good] == [(["ab", "cd"], 0), (["zz"], 1)]
    words = spark.createDataFrame([("tea",), ("dog",)], "word string")
    kinds = assist.label_kinds(words, lambda q: json.dumps({"tea": "drink", "dog": "nonsense", "cat": "animal"}), ["drink", "animal"]).collect()
    assert [tuple(r) for r in kinds] == [("tea", "drink")]
    assert {r["word"]: r["n"] for r in assist.curated(texts_of(spark, "tea and tea", "dog"), spark.createDataFrame([("tea",), ("absent",), ("a.b",)], "word string")).collect()} == {"tea": 2}
    assert assist.worthwhile_rule("<x>.*?</x>", ["a<x>b</x> and more text"]) and not assist.worthwhile_rule(".*", ["abc"]) and not assist.worthwhile_rule("(a+)+", ["aaa"])
