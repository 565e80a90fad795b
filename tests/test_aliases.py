import itertools
import random

from pyspark.sql import functions as F

from parley.operators import aliases as A
from parley.operators import packs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_pieces_meet_wherever_skeletons_are_alike():
    rng = random.Random(1)
    every = ["".join(rng.choices("pfts", k=rng.randint(2, 11))) for _ in range(250)]
    cut, searched = {s: set(A.piece_keys(s)) for s in every}, {s: set(A.place_keys(s)) for s in every}
    for a, b in itertools.product(every, every):
        if 1 - edits(a, b) / max(len(a), len(b)) >= A.SIMILAR:
            assert cut[a] & searched[b], (a, b)


def test_suggestions(spark):
    sounds = {"": "尼", "s": "西", "t": "德", "n": "妮", "k": "克", "l": "莱"}
    rows = spark.createDataFrame([("西德妮", 9), ("克莱", 5), ("咖啡", 5), ("sydney", 7), ("sydny", 2), ("clare", 3), ("table", 4), ("尼", 2)], "word string, n long")
    han = A.han_skeleton(F.col("word"), sounds)
    latin = {"sydney": "stn", "sydny": "stn", "clare": "kl", "table": "tpl"}
    side = F.when(F.col("word").rlike("^[a-z]+$"), "latin").otherwise("han")
    spoken = F.create_map(*[F.lit(x) for pair in latin.items() for x in pair])[F.col("word")]
    words = rows.select("word", "n", side.alias("side"), F.coalesce(spoken, han).alias("skeleton"))
    assert {r["word"]: r["skeleton"] for r in words.collect()} == latin | {"西德妮": "stn", "克莱": "kl", "咖啡": None, "尼": ""}
    got = {r["word"]: (r["suggested"], r["score"]) for r in A.suggestions(words).collect()}
    assert got == {"西德妮": ("sydney", 8.0), "sydney": ("西德妮", 8.0), "sydny": ("西德妮", 8.0), "克莱": ("clare", 8.0), "clare": ("克莱", 8.0)}
    groups = spark.createDataFrame([("sydny", "g"), ("table", "g"), ("sydney", "h")], "word string, group string")
    grouped = {r["word"]: (r["suggested"], r["score"]) for r in A.suggestions(words, groups).collect()}
    assert grouped == got | {"sydny": ("table", 12.0), "table": ("sydny", 12.0)}


def log(spark, rows):
    return spark.createDataFrame(rows, packs.LOG)


def state(df):
    return {(r["owner"], r["kind"], r["key"]): r["value"] for r in packs.rules(df).collect()}


def test_packs_apply_below_the_session_and_come_off_exactly(spark):
    pack = log(spark, [("name", 1, "set", "override", "a", "A"), ("name", 2, "set", "override", "b", "B"), ("name", 3, "set", "override", "a", "AA"), ("name", 4, "set", "stop", "s", ""), ("name", 5, "set", "override", "c", "C"), ("name", 6, "set", "override", "c", None)])
    cards = spark.createDataFrame([("one", None, "name"), ("two", "whole", "name"), ("three", None, "other")], "session string, strong string, weak string")
    found = packs.resolved(pack, cards)
    assert {tuple(r) for r in found.select("session", "fingerprint", "via").collect()} == {("one", "name", "weak"), ("two", "whole", "weak"), ("three", "other", "none")}
    moved = pack.unionAll(packs.migration(pack, found, 10))
    assert state(moved) == {(o, *k): v for o in ("name", "whole") for k, v in {("override", "a"): "AA", ("override", "b"): "B", ("stop", "s"): ""}.items()}
    again = packs.resolved(moved, cards)
    assert {(r["session"], r["via"]) for r in again.collect()} == {("one", "weak"), ("two", "strong"), ("three", "none")} and packs.migration(moved, again.where("session = 'two'"), 11).count() == 0
    session = log(spark, [("one", 1, "set", "override", "a", "mine"), ("two", 1, "set", "override", "z", "Z")])
    applied = session.unionAll(packs.application(session, moved, again, 20))
    assert state(applied) == {("one", "override", "a"): "mine", ("one", "override", "b"): "B", ("one", "stop", "s"): "", ("two", "override", "z"): "Z", ("two", "override", "a"): "AA", ("two", "override", "b"): "B", ("two", "stop", "s"): ""}
    edited = applied.unionAll(log(spark, [("one", 21, "set", "override", "b", "later"), ("one", 22, "set", "override", "n", "new")]))
    assert state(edited)[("one", "override", "b")] == "later"
    back = edited.unionAll(packs.undo(spark.createDataFrame([("one",)], "owner string"), 20, 23))
    assert {k: v for k, v in state(back).items() if k[0] == "one"} == {("one", "override", "a"): "mine", ("one", "override", "n"): "new"}
    assert {k: v for k, v in state(back).items() if k[0] == "two"} == {k: v for k, v in state(applied).items() if k[0] == "two"}
    nothing = applied.unionAll(packs.undo(spark.createDataFrame([("one",), ("two",)], "owner string"), 20, 23))
    assert state(nothing) == state(session)
