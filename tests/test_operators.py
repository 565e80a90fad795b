"""Operators on small fixtures of their own, where the tables hold nothing for them."""

import io
import json
import time
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from parley import analysis
from parley.operators import cleaning as C
from parley.operators import english as E
from parley.operators import kinds as K
from parley.operators import layout, overrides, sharing
from parley.operators import scanning as S
from parley.sources import bundle, chats


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a<!-- no -->b", "a b"),
        ("keep <panel hp=1>drop this</panel> keep", "keep keep"),
        ("left over</think>the story", "the story"),
        ("story <update>never closed", "story"),
        ("<b>bold</b> &amp; &#65;&#x42; &lt;", "bold & AB <"),
        ("say [OOC: not this] so {{user}}", "say so"),
        ("see [the page](http://x.y) or http://z.example/a b", "see the page or b"),
        ("one\nHP: 10/20\nMP: 5\nAge: 31\ntwo", "one\ntwo"),
        ("one\nHP: 10\ntwo", "one\nHP: 10\ntwo"),
        ("x\n.a {\ncolor: red;\n}\ny", "x\ny"),
        ("x\n| a | b |\n|---|---|\ny", "x\ny"),
        ("# head\n\n\n\n- item **b**", "head\n\nitem b"),
        ("<|im_start|>user\nhello", "hello"),
        (None, ""),
        ("story before <x><x><x><x>in</x></x></x></x> story after", "story before story after"),
        ("<状态栏>hp</状态栏>words<br/>here", "words here"),
        ("&#128512;&nope;x &amp;lt;", "\U0001f600 x &lt;"),
        ("时间：早上\n地点：家\n心情：好\nsaid", "said"),
        ("Ann: hi\nBob: ho\nAnn: yes\nsaid", "Ann: hi\nBob: ho\nAnn: yes\nsaid"),
        ("[高飞] one\n[高飞] two", "[高飞] one\n[高飞] two"),
        ("a [he stopped\nfor long\n]", "a [he stopped\nfor long\n]"),
        ("[INST] do it [/INST]\nyes", "yes"),
        ("x {\"a\": 1} y", "x {\"a\": 1} y"),
        ("return to the room.\nif only;\n", "return to the room.\nif only;"),
        ("::: a\nhidden", ""),
    ],
)
def test_clean(spark, text, want):
    got = one(spark, C.clean(F.col("t")), t=text)
    assert " ".join(got.split(" ")).replace("  ", " ").strip() == want


def test_clean_long_texts(spark):
    words = "plain words go on " * 30000
    assert one(spark, F.length(C.clean(F.col("t"))), t=f"a <panel>{words}</panel> b") <= 4
    assert one(spark, F.length(C.clean(F.col("t"))), t=f"a <panel>{'<i>x</i> ' * 300}</panel> b") <= 4
    assert one(spark, F.length(C.clean(F.col("t"))), t=words + "[" * 20000) > len(words)


def test_scans_take_time_in_proportion():
    def took(n):
        began = time.process_time()
        for s in ("<x>" * n + "</x>" * n, "<a " * n, "[" * n, '["a",' * n, '{"a":' * n, "<details><summary>" * n, "a: 1\n" * n, "[a:\n" * n, "::\n" * n, "[INST]\n" * n, "x;\n" * n):
            S.without_custom_tags(s, frozenset("b"))
            for step in (S.without_json, S.without_details, S.without_status, S.without_bracket_status, S.without_wrapped, S.without_colon_fences, S.without_instruct):
                step(s)
            S.without_runs(s, S.is_code, 3, True)
        return time.process_time() - began

    took(500)
    assert took(20000) < 30 * max(took(2000), 0.05)


def test_user_rules(spark):
    rules = bundle.clean_rules(json.dumps([{"findRegex": "/<(\\w+)>(.*?)<\\/\\1>/gs", "replaceString": "$2", "trimStrings": ["zz"]}, {"findRegex": "/now/i", "replaceString": "<b>then</b>"}]))
    assert [(r.find, r.replace, r.trims) for r in rules] == [("<(\\w+)>(.*?)<\\/\\1>", "$2", ("zz",)), ("now", "", ())]
    assert one(spark, C.apply_rules(F.col("t"), tuple(rules)), t="a <q>onezz</q> b <r>zztwo</r> NOW") == "a one b two "
    long = "keep " * 60
    assert one(spark, C.apply_rules(F.col("t"), (C.Rule(".+"),)), t=long) == long
    assert bundle.merged_rules(rules, [C.Rule("now", "x"), C.Rule("y")])[1:] == [rules[1], C.Rule("y")]


def test_reasoning(spark):
    rows = [(k, f"The rules of this house are long. I think of plan {k}.\n\"type\": \"string\",\n\"mood\": 3\nSo be it {k}.") for k in range(6)] + [(9, "<p1>x</p1>")]
    got = {r["id"]: r["text"] for r in C.clean_reasoning(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {k: f"I think of plan {k}.\nSo be it {k}." for k in range(6)}


def test_runs_keep_short_ones(spark):
    assert one(spark, C.without_runs(F.col("t"), S.is_panel, 3), t="a 1\nb 2\nx\na 1\nb 2\nc 3\n") == "a 1\nb 2\nx\n"


def test_repeated_lines(spark):
    texts = spark.createDataFrame([(k, f"same line here\nown {k}") for k in range(8)], "id long, text string")
    assert {r["text"] for r in C.strip_repeated(texts).collect()} == {f"own {k}" for k in range(8)}
    few = texts.where("id < 3")
    assert C.repeated_lines(few).count() == 0


def test_base_forms(spark):
    forms = lambda w: set(one(spark, E.base_forms(F.col("w")), w=w))
    assert forms("stories") >= {"story"} and forms("stopped") >= {"stop"} and forms("sliding") >= {"slide"}
    assert forms("king") == set() and forms("glass") == set() and "looks" not in forms("looks")
    assert one(spark, E.possessive_base(F.col("w")), w="nicole’s") == "nicole"


def test_base_forms_of_every_word(spark):
    forms = lambda w: set(one(spark, E.base_forms(F.col("w")), w=w))
    assert forms("agreed") == {"agre", "agree"} and forms("freed") == {"fre", "free"}
    assert forms("dvds") == {"dvd"} and forms("html's") >= {"html"}
    counts = spark.createDataFrame([("agreed", 3), ("agrees", 2), ("agree", 5), ("dvds", 2), ("dvd", 5)], "word string, n long")
    assert {r["word"]: r["form"] for r in E.merge_plan(counts, []).collect()} == {"agrees": "agree"}  # folds as its SQL does


def test_merge_plan(spark):
    counts = spark.createDataFrame([("look", 2), ("looks", 9), ("looked", 3), ("zorking", 1), ("anna's", 4)], "word string, n long")
    plan = {r["word"]: r["form"] for r in E.merge_plan(counts, ["the"]).collect()}
    assert plan == {"look": "looks", "looked": "looks", "anna's": "anna"} or {k: v for k, v in plan.items() if k != "look"} == {"looked": "looks", "anna's": "anna"}


def test_kinds(spark):
    words = ["王先生", "茶", "zork", "小河", "生日", "十年", "朝阳区", "小区", "对面", "面", "一路", "问道", "10:30", "the", "茶", "电影"]
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n int")
    got = {(r["word"], r["n"]): [t["kind"] for t in r["tags"]] for r in K.typed(rows).collect()}
    want = [["person"], ["drink"], ["plain"], ["nature"], ["plain"], ["time"], ["region"], ["plain"], ["plain"], ["plain"], ["plain"], ["speech"], ["time"], ["plain"], ["drink"], ["media"]]
    assert got == {(w, k): x for k, (w, x) in enumerate(zip(words, want))}
    own = K.rule_table(spark).unionAll(spark.createDataFrame([("myth", "word", "zork", 1), ("food", "end", "k", 4)], "kind string, how string, value string, least int"))
    assert {r["word"]: [t["kind"] for t in r["tags"]] for r in K.typed(rows.where("word = 'zork'"), own).collect()} == {"zork": ["food", "myth"]}
    marked = K.typed(rows.where("n = 1")).select(K.mark_generic(F.col("tags"), F.lit(True)).alias("tags")).first()["tags"]
    assert [t["kind"] for t in marked] == ["drink", "generic"]
    assert len(K.CONF) == 50 and {r.kind for r in K.RULES} | {k for k, _ in K.PATTERNS} == set(K.CONF)


def test_aliases(spark):
    words = spark.createDataFrame([("A", 5), ("b", 3), ("c", 2), ("x", 1), ("y", 1)], "word string, n long")
    aliases = spark.createDataFrame([("a", "b"), ("b", "C"), ("x", "y"), ("y", "x")], "source string, target string")
    assert {r["word"]: r["n"] for r in overrides.apply_aliases(words, aliases).collect()} == {"c": 10, "x": 1, "y": 1}
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)], "source string, target string")
    assert {r["final"] for r in overrides.alias_closure(chain).collect()} == {"n40"}


def test_priority(spark):
    assert one(spark, overrides.parse_priority(F.col("t")), t=" a ;B；b;;" + "x" * 40 + ";c") == ["a", "B", "c"]


def test_layout_has_no_overlap():
    words = [(f"word{k}", 100.0 - k) for k in range(60)]
    placed = layout.place_words(words, 1200, 800)
    assert len(placed) > 30 and placed == layout.place_words(words, 1200, 800)
    for i, p in enumerate(placed):
        for q in placed[:i]:
            assert abs(p["x"] - q["x"]) * 2 >= p["w"] + q["w"] or abs(p["y"] - q["y"]) * 2 >= p["h"] + q["h"]


def test_sharing(spark):
    head, words = {"theme": "x"}, [("zwei worte", 3), ("é", 2)]
    assert sharing.decode_share(sharing.encode_share(head, words)) == (head, words)
    url = sharing.share_url("https://example.org/", head, [(f"w{k * 7919 % 1000}", k) for k in range(500)])
    assert len(url) <= sharing.LONGEST_URL
    table = spark.createDataFrame([('a"b', 3, "plain", False), ("c", 5, "plain", True)], "word string, n long, kind string, priority boolean")
    assert sharing.csv_text(table) == '﻿word,count,kind,source\nc,5,plain,priority\n"a""b",3,plain,tokenizer\n'
    assert sharing.export_name("{card}-{mode}-{date}-{n}", 'a/b: "c"', "m", 3, date(2024, 1, 2)) == "ab c-m-2024-01-02-3"


MESSAGES = [
    {"user_name": "Me", "character_name": "unused", "chat_metadata": {"world_info": "W"}},
    {"name": "Me", "is_user": True, "mes": "hi", "extra": []},
    {"name": "Ann", "mes": "one", "swipes": ["zero", "two"], "swipe_id": 1, "extra": {"model": "m", "reasoning": "why"}, "gen_started": "2024-01-01T00:00:00Z", "gen_finished": "2024-01-01T00:00:03Z"},
    {"name": "Ann", "is_system": True, "mes": "hidden"},
    {"name": "Bot", "is_system": True, "mes": "notice"},
    {"name": "Sys", "mes": "told", "extra": {"type": "narrator"}},
    {"name": "Ann", "mes": "FILEtext", "extra": {"fileLength": 4}},
    {"name": "Ann", "mes": "raw", "extra": {"display_text": "shown"}},
]


def test_json_lines(spark):
    content = "\n".join([json.dumps(MESSAGES[0]), "{broken", *map(json.dumps, MESSAGES[1:])])
    files = spark.createDataFrame([("Card - 2024-01-01@00h00m00s0ms.jsonl", content)], "source string, content string")
    rows = chats.records(chats.file_lines(files))
    got = chats.messages(rows).orderBy("index").collect()
    assert [(r["role"], r["raw"]) for r in got] == [("user", "hi"), ("char", "two"), ("char", "hidden"), ("system", "notice"), ("system", "told"), ("char", "text"), ("char", "shown")]
    assert got[1]["gen_seconds"] == 3.0 and got[1]["model"] == "m" and got[1]["swipe_count"] == 2 and got[1]["reasoning"] == "why"
    about = chats.chats(rows).first()
    assert (about["user_name"], about["card"], about["world_info"], about["broken_lines"]) == ("Me", "Card", "W", 1)


def test_json_documents_and_formats(spark):
    array, wrapped = json.dumps(MESSAGES[1:3]), json.dumps({"messages": MESSAGES[1:3]}, indent=1)
    files = spark.createDataFrame([("a.json", array), ("b.json", wrapped), ("c.json", json.dumps(MESSAGES[1], indent=1))], "source string, content string")
    got = chats.messages(chats.records(chats.json_documents(files))).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a.json": 2, "b.json": 2, "c.json": 1}
    kinds = {"x.zip": "", "a.txt": '{"a": 1}\n{', "b.jsonl": "{\n", "c.txt": "hello", "d": "Ann: hi", "e": "nothing"}
    rows = spark.createDataFrame(list(kinds.items()), "source string, head string")
    found = {r["source"]: r["k"] for r in rows.select("source", chats.detect_format(F.col("source"), F.col("head")).alias("k")).collect()}
    assert found == {"x.zip": "zip", "a.txt": "jsonl", "b.jsonl": "json", "c.txt": "txt", "d": "txt", "e": "unknown"}


def test_plain_text(spark):
    text = "header\nAnn: first line\nsecond line\nMe: short\nAnn: third"
    files = spark.createDataFrame([("f.txt", text)], "source string, content string")
    got = chats.plain_text(chats.file_lines(files)).orderBy("index").collect()
    assert [(r["name"], r["role"], r["raw"]) for r in got] == [("Ann", "char", "first line\nsecond line"), ("Me", "user", "short"), ("Ann", "char", "third")]


def test_read_takes_every_kind(spark, tmp_path):
    meta = {"user_name": "Me", "character_name": "Ann", "chat_metadata": {"world_info": "w" * 6000}}
    (tmp_path / "long.jsonl").write_text("\n".join(json.dumps(x) for x in [meta, *MESSAGES[1:3]]) + "\nbroken")
    (tmp_path / "short one.jsonl").write_text(json.dumps(MESSAGES[2]))
    (tmp_path / "whole.json").write_text(json.dumps({"messages": MESSAGES[1:3]}, indent=1))
    (tmp_path / "talk.txt").write_text("Ann: first\nmore\nMe: second")
    (tmp_path / "odd.bin").write_text("nothing here")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("chats/Bob/b.jsonl", json.dumps(MESSAGES[1]))
        z.writestr("chats/Ann Lee/c.jsonl", json.dumps(MESSAGES[2]))
        z.writestr("backups/chat_ann_lee_20240101-000000.jsonl", json.dumps(MESSAGES[1]))
    got = {(r["source"], r["index"]): r["raw"] for r in chats.read(spark, str(tmp_path)).collect()}
    assert got == {
        ("long.jsonl", 0): "hi", ("long.jsonl", 1): "two", ("short one.jsonl", 0): "two", ("whole.json", 0): "hi", ("whole.json", 1): "two",
        ("talk.txt", 0): "first\nmore", ("talk.txt", 1): "second", ("Bob/b.jsonl", 0): "hi", ("Ann Lee/c.jsonl", 0): "two",
    }
    assert {tuple(r) for r in chats.warnings(spark, str(tmp_path)).collect()} == {("odd.bin", "unknown_format", 1), ("long.jsonl", "broken_lines", 1)}


def test_analysis_options(spark):
    said = "the river runs to the old mill"
    rows = [("s1", "c", k, "Ann" if k % 2 else "Me", "char" if k % 2 else "user", f"{said} {'clown' * (k % 3)}", None, f"I think of stone {k}" if k == 3 else None, "m1") for k in range(12)]
    rows += [("s2", "d", 0, "Narrator", "system", "hidden words", None, None, None)]
    messages = spark.createDataFrame(rows, "source string, card string, index int, name string, role string, text string, date string, reasoning string, model string")
    messages = messages.withColumns({"raw": F.col("text"), "api": F.lit(None).cast("string"), "gen_seconds": F.lit(1.0), "swipe_count": F.lit(1)})
    words = lambda **o: {r["word"]: r["n"] for r in analysis.analyze(messages, analysis.Options(**o)).words.collect()}
    assert words()["clown"] == 4 and "hidden" not in words() and "river" not in words(baseline=("river",))
    assert words(min_count=1, roles=("system",)) == {"hidden": 1, "words": 1}
    assert words(speakers=("Me",))["river" if "river" in words(speakers=("Me",)) else "mill"] <= 6
    assert words(source="reasoning", min_count=1) == {"think": 1, "stone": 1} and words(source="reasoning", model="m2") == {}
    flagged = spark.createDataFrame([("clown", "mild")], "word string, flag string")
    for mode, holds in (("hide", False), ("only", True)):
        got = {r["word"] for r in analysis.analyze(messages, analysis.Options(flagged=mode), flagged).words.collect()}
        assert ("clown" in got) == holds and (got == {"clown"}) == holds
    assert {r["word"] for r in analysis.analyze(messages).all_words.collect()} <= {w for r in rows for w in r[5].split()}


def test_archive(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("data/chats/Ann/a.jsonl", "live")
        z.writestr("data/backups/chat_ann_20240101-000000.jsonl", "old")
        z.writestr("data/backups/chat_bob_20240101-000000.jsonl", "bob old")
        z.writestr("data/backups/chat_bob_20240201-000000.jsonl", "bob new")
        z.writestr("data/worlds/w.json", json.dumps({"entries": {"0": {"key": ["龙城", "a", "lower words"]}}}))
        z.writestr("data/other.bin", "x")
    archives = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    found = bundle.entries(archives)
    assert {(r["source"], r["content"]) for r in bundle.chat_files(found).collect()} == {("Ann/a.jsonl", "live"), ("data/backups/chat_bob_20240201-000000.jsonl", "bob new")}
    assert [r["keyword"] for r in bundle.world_keywords(found).collect()] == ["龙城"]


def test_cards_and_rules():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\0IEND\xaeB`\x82"
    assert bundle.card_json(bundle.with_card(bundle.with_card(png, "old"), '{"name": "Ann"}')) == '{"name": "Ann"}'
    rules = bundle.clean_rules(json.dumps([{"findRegex": "/a+/g"}, {"findRegex": "/(a+)+/"}, {"findRegex": "/.*/"}, {"findRegex": "b", "disabled": True}, {"findRegex": "/a+/g", "replaceString": "x"}, {"findRegex": "c", "markdownOnly": True}]))
    assert [(r.find, r.markdown_only) for r in rules] == [("c", True), ("a+", False)]
    assert [bundle.nests_quantifiers(x) for x in ("(a+)+", "(ab)+", r"\(a+\)+", "[(a+)]+", "((a+)b)+", "(?:x*)*", "a+(b)")] == [True, False, False, False, True, True, False]


def test_sources_of_one_name_stay_apart(spark, tmp_path):
    for who in ("Ann", "Bob"):
        (tmp_path / who).mkdir()
        (tmp_path / who / "1 a+b.jsonl").write_text("\n".join(json.dumps({"name": who, "is_user": False, "mes": f"{who} {k}"}) for k in range(3)))
    got = [tuple(r) for r in chats.read(spark, str(tmp_path)).select("source", "index", "card", "raw").orderBy("source", "index").collect()]
    assert got == [(f"{who}/1 a+b.jsonl", k, who, f"{who} {k}") for who in ("Ann", "Bob") for k in range(3)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    want = {}
    for name, n in (("long.txt", 5000), ("short.txt", 3), ("empty.txt", 0), ("unended.txt", 700)):
        rows = [f"{name} {k} " + "x" * (k % 90) for k in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if n and name != "unended.txt" else ""))
        want |= {(name, k): row for k, row in enumerate(rows)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("4k", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            lines = chats.split_lines(spark, str(tmp_path))
            got = {(r["source"], r["line_no"]): r["line"] for r in lines.collect()}
            assert got == want
            if size == "4k":
                assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_lines_go_row_by_row(spark, monkeypatch):
    for n in (400, 600):  # below and above what is put into the expression
        common = "\n".join(f"common line {k}" for k in range(n))
        rows = [(k, common) for k in range(6)] + [(None, common + "\nmine"), (7, "seven a\n" + common), (7, "seven b"), (8, None), (9, "twice\ntwice"), (9, "twice\ntwice")]
        got = C.strip_repeated(spark.createDataFrame(rows, "id long, text string")).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(k, "") for k in range(6)] + [(None, "mine"), (7, "seven a"), (7, "seven b"), (8, ""), (9, "twice\ntwice"), (9, "twice\ntwice")]))


def test_json_after_any_number_of_open_brackets():
    data = '{"status": "fine", "n": [1, 2, 3]}'
    for n in (0, 1, 50, 120, 5000):
        assert S.without_json("[" * n + " x " + data + " y") == "[" * n + " x   y"
    assert S.without_json('[[ {"a": "long enough to go", "b": 1} ] and more') == "[  and more"
    assert S.without_json('["an unended string [{"k": "long enough to go away"}] end') == '["an unended string   end'
    assert S.without_json('{"cut off": {"whole": "and long enough to go"}, "open": [') == '{"cut off":  , "open": ['
    assert S.without_json('[{"a": 1}]') == '[{"a": 1}]'
    deep = "[" * 30_000 + '"x"' + "]" * 30_000
    assert S.without_json(deep) == " "
    began = time.perf_counter()
    for _ in range(3):
        S.without_json(('{"a":[' * 450 + "x ") * 80)
    assert time.perf_counter() - began < 10


def test_details_where_lower_case_is_longer():
    label = S.SCAFFOLD_LABELS[0]
    assert S.without_details(f"İ a <DETAILS><Summary>{label.upper()}</SUMMARY>hidden</Details> b").split() == ["İ", "a", "b"]


def test_status_blocks_by_strength():
    pairs = lambda *rows: [S.pair_of(r) for r in rows]
    field = S.STATUS_FIELDS[0]
    assert S.is_status(pairs(f"{field}: whatever she may feel at this very hour", "a: b", "c: d"))
    assert S.is_status(pairs("load: 10/20", "coins: 35", "walks: home"))
    assert not S.is_status(pairs("load: 10/20", "coins: 35")) and not S.is_status(pairs("load: 1", "load: 2", "coins: 3"))
    assert not S.is_status(pairs("load: 10/20", "coins: 35", "ann: this is what she has said to me"))
