import random

import pytest
from pyspark.sql import functions as F

from parley.operators import entities as E
from parley.operators import phrases as P
from parley.operators import segment as G


def cheapest(run, words):
    """(cost, path) over all ways to cut a run; of equally cheap ones the longest last word, at each place."""
    best = {0: (0, [])}
    for end in range(1, len(run) + 1):
        ways = []
        for size in range(1, end + 1):
            w = run[end - size : end]
            for price in ([words[w]] if w in words else []) + [G.UNKNOWN] * (size == 1):
                ways.append((best[end - size][0] + price, -size, [*best[end - size][1], w]))
        best[end] = (min(ways)[0], min(ways)[2])
    return best[len(run)]


def test_path_is_the_cheapest():
    rng = random.Random(3)
    letters = "甲乙丙丁"
    for _ in range(200):
        words = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.choice([5, 10, 20, 60]) for _ in range(12)}
        run = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        assert G.Lattice(words).path(run) == cheapest(run, words)[1]
    assert G.Lattice({}).path("") == [] and G.Lattice({"": 1}).path("甲") == ["甲"]
    long = "甲乙" * 50_000
    assert G.Lattice({"甲乙": 1}).path(long) == ["甲乙"] * 50_000


def test_segmented_texts(spark):
    words = spark.createDataFrame([("通告", 5), ("通告单", 5), ("是", 5), ("通告", 9), (None, 1)], "word string, cost int")
    segmented = G.segmenter(words)
    rows = spark.createDataFrame([(1, "通告单是A4纸，x通告。 done"), (2, None), (3, ""), (4, "no Han")], "id int, text string")
    got = {r["id"]: r["t"] for r in rows.select("id", segmented(F.col("text")).alias("t")).collect()}
    assert got == {1: "通告单 是 A4 纸，x 通告。 done", 2: None, 3: "", 4: "no Han"}
    tokens = [[list(c) for c in r["c"]] for r in rows.where("id = 1").select(P.chunks(segmented(F.col("text")), segmented=True).alias("c")).collect()]
    assert tokens == [[["通告单", "是", "A4", "纸"], ["x", "通告"], ["done"]]]
    assert [r[0] for r in rows.select(G.unknown(F.lit("通告单"), segmented), G.unknown(F.lit("单通告"), segmented)).limit(1).collect()[0:1]] == [False]
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError):
        m.setattr(G, "LEXICON_BOUND", 2)
        G.segmenter(words)


def test_names_need_places_and_lose_what_was_swallowed(spark):
    # at the start of a text nothing tells 见沈砚秋 from a longer name, and 林薇轻 is met once
    said = ["沈砚秋说道，好", "沈砚秋点了点头", "沈砚秋的声音", "看见沈砚秋坐下", "沈砚秋：走"] * 2
    said += ["地板是冷的"] * 9 + ["妈妈点了点头"] * 9 + ["林薇轻笑了笑", "林薇笑了笑", "林薇笑了笑", "林薇的手", "林薇，你"]
    texts = spark.createDataFrame([(t,) for t in said], "text string")
    got = {r["name"]: (r["places"], r["n"]) for r in E.persons(texts, F.lit(True)).collect()}
    assert got == {"沈砚秋": (4, 8), "林薇": (3, 4)}
    assert [r["name"] for r in E.persons(texts, F.lit(True), vetoed=F.col("name") == "林薇").collect()] == ["沈砚秋"]
    assert E.persons(texts, F.lit(False)).select("name").collect() == [("沈砚秋",), ("林薇",)] or {r["name"] for r in E.persons(texts, F.lit(False)).collect()} == {"沈砚秋", "林薇"}
    assert E.persons(texts.where("false"), F.lit(True)).count() == 0


def test_hits_do_not_overlap(spark):
    texts = spark.createDataFrame([(1, "aaaa aXa"), (2, None), (3, "小沈小沈沈")], "id long, text string")
    got = {(r["id"], r["needle"]): r["n"] for r in E.hits(texts, ["aa", "a", "小沈", "沈", ""]).collect()}
    assert got == {(1, "aa"): 2, (1, "a"): 6, (3, "小沈"): 2, (3, "沈"): 3}
    assert E.hits(texts, []).count() == 0


def test_shapes_of_names(spark):
    words = ["赵总", "王老师", "Maya Torres", "Maya", "赵一文", "欧阳明月", "沙发上", "白裙", "妮娜莉", "赵一板", "赵一的", "x" * 30]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r["w"] for r in rows.where(E.looks_like_person(F.col("w"), ("赵", "白"), F.lit(True), "妮娜莉丝")).collect()]
    assert got == ["赵总", "王老师", "Maya Torres", "赵一文", "欧阳明月", "妮娜莉"]
    assert rows.where(E.looks_like_person(F.col("w"), ("赵",), F.lit(False), "妮娜莉丝")).count() == 3


def test_brands(spark):
    rows = spark.createDataFrame([(1, "他有Nike牌的鞋，Puma 公司，apple和Apple公司"), (2, "穿" + "。" * 11 + "古驰" + "很好"), (3, "买古驰。"), (4, "古驰款"), (5, "古驰" + "。" * 12 + "买古驰驰驰驰驰")], "id long, text string")
    assert {r["word"] for r in E.latin_brands(rows).collect()} == {"nike", "puma"}
    got = {r["word"]: r["n"] for r in E.near_trade(rows, "古驰", bounds=E.Bounds(brand_uses=1)).collect()}
    assert got == {"古驰": 3}  # the fifth stands a character too far from the word, and a run of seven is none


def test_short_forms(spark):
    known = spark.createDataFrame([("老师", 1000)], "word string, n long")
    segmented = G.segmenter(G.lexicon(known))
    unknown = lambda w: G.unknown(w, segmented)
    said = ["沈砚秋说了话，老沈笑了", "老沈走了", "老沈来了", "沈砚秋的手", "沈砚秋，砚秋", "小沈"] * 3
    said += ["周敬亭说了，周老师来了", "周老师走了", "钱一并来了，钱老师"] * 3 + ["钱一并，你", "钱一并的手", "钱一并说道，", "周敬亭的手", "周敬亭，我"] * 3
    texts = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    names = spark.createDataFrame([("沈砚秋", 5), ("周敬亭", 5), ("钱一并", 5), ("周老师", 5), ("老沈", 5), ("沈高飞", 2)], "name string, places long")
    got = {(r["full"], r["alias"]) for r in E.short_forms(texts, names, ("沈", "周", "钱"), unknown).collect()}
    # 小沈 never shares a text with the full name, 老师 is worn by two; given names that stand only inside full ones are theirs
    assert got == {("沈砚秋", "老沈"), ("沈砚秋", "砚秋"), ("周敬亭", "敬亭"), ("钱一并", "一并")}
    assert E.short_forms(texts.where("false"), names, ("沈",), unknown).count() == 0
