import textwrap

from parley.llm import licences

BODY = {name: body for name, _, body in licences.TEXTS}


def test_variants_of_a_text_and_a_notice(spark):
    mit = "MIT License\n\nCopyright (c) <year> <holders>\n\n" + BODY["MIT"]
    changed = mit.replace("License", "LICENCE").replace("\n\n", "\n \n").replace("Copyright (c) <year> <holders>", "Copyright 2019 Some One\n(c) Another").replace(",", " ,")
    rows = [
        (1, mit, 0), (2, changed, 0), (3, "Some text.\n  released UNDER the MIT licence\nmore", 0), (4, None, 0), (5, "", 0),
        (6, "mit", 0), (7, "x " * 50000 + "\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", 0), (1, mit, 0), (8, "© 2020", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license long")
    got = {r["doc_id"]: (r["text_license"], r["notices"], r["n_notices"]) for r in licences.scan(docs).collect()}
    assert got[1][0] == got[2][0] == "MIT"
    assert got[3] == (None, "MIT", 1)
    assert got[4] == got[5] == got[6] == got[8] == (None, "", 0)
    assert got[7] == (None, "CC-BY-NC-4.0,MIT", 2)
    assert len(got) == 8
    assert licences.scan(docs.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_layouts_of_entire_texts(spark):
    wrap = lambda t, n=72: "\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    rows, want = [], {}
    for name, titles, body in licences.TEXTS:
        for n in (40, 47, 60, 66, 72, 80, 100):
            for text in (wrap(body, n), f"{titles[-1]}\nCopyright (c) 2019-2021, Some One\nAll rights reserved.\n\n{wrap(body, n)}"):
                want[len(rows)] = name
                rows.append((len(rows), text))
        for text in (body.replace("\n", " "), "Copyright (c) 2020 Some One. " + body.replace("\n", " "), body.replace("1. ", "(a) ").replace("\n", "\r\n")):
            want[len(rows)] = name
            rows.append((len(rows), text))
    got = {r["doc_id"]: r["text_license"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_callers_notices_in_lines(spark, monkeypatch):
    known = spark.createDataFrame([("own", "May be used freely by anyone."), ("own2", "Sub-licence as you like"), ("own3", "copyright notices stay")], "license string, text string")
    rows = [(1, "first\n2) MAY be used freely, by anyone\nlast"), (2, "a\nsublicense as you like\n---\nCopyright notices stay"), (3, "Copyright 2020 x\nmay be used"), (None, "May be used freely by anyone."), (None, None)]
    got = {r["doc_id"]: (r["text_license"], r["notices"], r["n_notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: (None, "own", 1), 2: (None, "own2,own3", 2), 3: (None, "", 0), None: ("own", "own", 1)}
    monkeypatch.setattr(licences, "MOST_FIRSTS", 1)
    again = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert {r["doc_id"]: (r["text_license"], r["notices"], r["n_notices"]) for r in again} == got
