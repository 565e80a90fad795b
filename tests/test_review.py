import io
import json
import zipfile

from pyspark.sql import functions as F

from parley.operators import layout, overrides
from parley.operators import phrases as P
from parley.operators import review as R
from parley.sources import bundle, demo
from parley.streaming.counts import IncrementalCounts


def test_mcnemar():
    assert R.mcnemar(0, 0) == 1.0 and R.mcnemar(5, 5) == 1.0
    assert abs(R.mcnemar(1, 9) - 2 * (1 + 10) / 2**10) < 1e-12
    assert abs(R.mcnemar(40, 20) - 0.01417) < 1e-4 and R.mcnemar(40, 20) == R.mcnemar(20, 40)


def test_fingerprints(spark):
    rows = spark.createDataFrame([("Ann v2", "x"), ("ＡＮＮ", "x"), ("ann (1.3)", "y"), ("Bob", "x")], "name string, content string")
    weak = [r[0] for r in rows.select(R.fingerprint(F.col("name"))).collect()]
    strong = [r[0] for r in rows.select(R.fingerprint(F.col("name"), F.col("content"))).collect()]
    assert weak[0] == weak[1] == weak[2] != weak[3]
    assert strong[0] == strong[1] != strong[2]


def test_flags_by_rank(spark):
    words = spark.createDataFrame([("abc", 1), ("xabcx", 2), ("aq", 3), ("q", 4), ("qqq", 5), ("ab", 6)], "word string, n long")
    listed = spark.createDataFrame([("abc", "one", 0), ("xab", "two", 1), ("q", "three", 2)], "entry string, flag string, place long")
    assert {r["word"]: r["flag"] for r in R.flag_words(words, listed).collect()} == {"abc": "one", "xabcx": "one", "aq": R.MAYBE, "q": "three", "qqq": None, "ab": None}
    assert {r["flag"] for r in R.flag_words(words, listed.where("false")).collect()} == {None}


def test_settings(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("settings.json", json.dumps({"main_api": "m", "active_character": "a.png", "power_user": {"sysprompt": {"name": "p"}}, "preset_settings": "s", "extension_settings": {"regex": [{"findRegex": "/x+/"}]}}))
    found = bundle.entries(spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary"))
    row = bundle.settings(found).first()
    assert (row["preset"], row["prompt"], row["active_character"], row["service"]) == ("s", "p", "a.png", "m")
    assert [r.find for r in bundle.clean_rules(row["rules"])] == ["x+"]


def test_counts_in_levels(spark, tmp_path):
    counts = IncrementalCounts(spark, str(tmp_path / "c"), fan=2)
    for k in range(5):
        counts.merge(spark.createDataFrame([(f"hello world{k} hello",)], "text string"), k)
        counts.merge(spark.createDataFrame([(f"hello world{k} hello",)], "text string"), k)  # run again
        got = {r["word"]: r["n"] for r in counts.counts(k + 1).collect()}
        assert got == {"hello": 2 * (k + 1), **{f"world{j}": 1 for j in range(k + 1)}}


def test_small_things(spark):
    rows = spark.createDataFrame([(["我是", "但是", "是", "they"],)], "t array<string>")
    assert rows.select(P.split_copula(F.col("t"), ("但是",))).first()[0] == ["我", "是", "但是", "是", "they"]
    assert layout.can_stack("灯笼") and not layout.can_stack("a灯") and not layout.can_stack("灯")
    assert layout.stacked("灯笼果", 10) == [("灯", -10.5), ("笼", 0.0), ("果", 10.5)]
    word = spark.createDataFrame([("龙门", None), ("b", "B")], "word string, own string")
    assert [r[0] for r in word.select(overrides.displayed(F.col("word"), ("龙门", "龍門"), F.col("own"))).collect()] == ["龍門", "B"]
    assert demo.demo(spark, "zh").count() == 12 and demo.demo(spark, "xx").first()["word"] == "lantern"


def test_payload_of_a_contribution(spark):
    rows = [("ann", 9, "person", None, False), ("river", 8, "nature", None, False), ("龙", 4, "myth", None, False), ("rude", 7, "plain", "mild", False), ("mine", 6, "plain", None, True), ("rare", 1, "plain", None, False), ("lake", 3, "nature", None, False)]
    words = spark.createDataFrame(rows, "word string, n long, kind string, flag string, priority boolean")
    changed = spark.createDataFrame([("rare", "place"), ("lake", "nature"), ("ann", "place")], "word string, kind string")
    got = R.payload(words, changed).first().asDict(recursive=True)
    assert [tuple(x.values()) for x in got["words"]] == [("river", 8, "nature"), ("龙", 4, "myth"), ("lake", 3, "nature")]
    assert got["share"] == round(4 / 15, 6) and got["kinds"] == {"nature": 2, "myth": 1} and [tuple(x.values()) for x in got["fixes"]] == [("ann", "place"), ("rare", "place")]
    assert R.payload(words.where("false"), changed.where("false")).first()["words"] == []
