import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import pii


def brute(text):
    """The patterns as they are worded, by plain regular expressions."""
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            s = sum(int(x) if j % 2 == 0 else sum(divmod(2 * int(x), 10)) for j, x in enumerate(d[::-1]))
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and s % 10 == 0, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@-+ 0155(9é%_", max_size=60))
def test_patterns_equal_their_wording(text):
    assert pii.base_spans(text) == brute(text)


def test_patterns_on_real_data(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sum(len(brute(t)) for t in texts) > 50
    for t in texts:
        assert pii.base_spans(t) == brute(t)


def test_long_runs_are_linear():
    for text in ("a" * 200000, "1" * 200000, "a@" * 50000, "+1 " * 50000, "1." * 50000, "a@" + "b" * 100000, "1" * 5000 + ".1.1.1 " + "7" * 2000000):
        assert len(pii.base_spans(text)) < 60000
    assert pii.base_spans("0" * 5000 + ".1.1.1") == brute("0.1.1.1")[:0] + [(0, 1, 5006)]
    for text in ("a" + "=" * 400000 + "a", "a_" + "b" * 400000, "=_" * 200000 + "x"):
        assert pii.plausible(5, text) in (True, False)


def test_very_long_tokens_are_judged_whole(spark):
    texts = ["0" * 5000 + ".1.1.1", "9" * 100000, "=_" * 100000, "+1 " + "2" * 30000, "a." * 60000 + "@b.cd"]
    got = pii.find(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a@b.cd")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"]) for r in got} == {0: (0, 1), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), None: (1, 0)}


def test_the_field_finds_what_the_patterns_miss(spark):
    texts = {
        1: "the thing token = \"27660c51feb63980dfaee7464f96210544c03fc3\" there", 2: "say password=e3b3ed3cc8548923d6 again", 3: "mail jan.doe(at)mail.example.com now",
        4: "only words in here, 12 of them. And 7.5% of it!", 5: None, 6: "", 7: "x" * 300000 + " a@b.cd", 8: "é a@b.cd 1.2.3.4",
    }
    docs = spark.createDataFrame([*((k, t, "z") for k, t in texts.items()), (8, texts[8], None)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert "secret:" in got[1]["spans"] and "secret:" in got[2]["spans"] and "email:" in got[3]["spans"]
    none = hashlib.sha256(b"").hexdigest()
    assert all(got[k]["spans"] == "" and got[k]["base_sha256"] == none for k in (4, 5, 6))
    assert got[7]["spans"] == "email:300001:300007"
    assert got[8]["spans"] == "email:2:8,ip:9:16" and (got[8]["n_email"], got[8]["n_ip"]) == (1, 1)
    assert got[8]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()
    assert pii.find(docs).count() == 9 and pii.find(docs.where("false")).count() == 0
    texts = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert texts[8]["text"] == "é [EMAIL] [IP]" and texts[5]["text"] is None and texts[1]["spans"] == "z"


def test_overlaps_are_replaced_once():
    assert pii.redacted_text("ab 1234 cd", [("card", 3, 7), ("phone", 4, 7)]) == "ab [CARD] cd"
