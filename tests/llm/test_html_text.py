import html
import re
import time

import numpy as np

from parley.llm import html_text as h


def test_held_out_pages():
    trees = h.trained()
    pages = h.labelled_pages(120, seed=77)
    right = sum(got == " ".join(main.split()) for got, (_, main) in zip(h.main_texts([s for s, _ in pages], trees), pages))
    assert right / len(pages) > 0.8


def test_real_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()

    def article(x):
        inner = x[x.index("<article>") + 9 : x.index("</article>")]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())

    got = {r["page_id"]: r for r in h.op9_html_text(spark, "/root/testdata/sf0.01").collect()}
    right = sum(got[r["page_id"]]["text"] == article(r["html"]) for r in rows)
    assert right / len(rows) > 0.97
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_no_child_of_a_dropped_node_is_kept():
    trees = h.trained()
    for source, _ in h.labelled_pages(20, seed=3):
        page = h.parse(source)
        keep = h.kept_nodes(page, trees.logit(h.features([page])))
        assert all(not keep[x.index] or x.parent is None or keep[x.parent.index] for x in page.nodes)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    page = h.parse("<div>a<p>bb</p><div>c<p>dd</p></div></div><div>e<p>ff</p></div>")
    n, logits = len(page.nodes), rng.normal(size=(30, len(page.nodes))) * 2
    for logit in logits:
        value = [v * (np.log1p(x.own) if x.own else 1.0) for v, x in zip(logit, page.nodes)]
        score = lambda keep: sum(v if k else -v for v, k in zip(value, keep))  # noqa: E731, B023
        best = max(
            (k for k in ([True, *(bool(m >> j & 1) for j in range(n - 1))] for m in range(2 ** (n - 1))) if all(not k[x.index] or x.parent is None or k[x.parent.index] for x in page.nodes)),
            key=score,
        )
        assert np.isclose(score(h.kept_nodes(page, logit)), score(best))


def test_markup():
    texts = lambda s: [(t, n.name) for t, n, _ in h.parse(s).texts]
    assert texts("<p>a &amp; b<p>c<br>d</p><!-- x <b> -->e<script>if (a<b) '</p>'</script>f") == [("a & b", "p"), ("c", "p"), ("d", "p"), ("e", "#root"), ("f", "#root")]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><style>x") == [("a", "li"), ("b", "li"), ("c", "li")]
    assert texts("a < b<p class=\"x>y\">c</p") == [("a < b", "#root"), ("c", "p")]
    assert texts("") == []


def test_time_grows_with_the_length():
    def took(n):
        shapes = ("<div>" * n + "</section>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<ul><li>" + "<div>" * n + "<li></li>" * n, "<li><ul><div>" + "<div>" * n + "<li></li>" * n, "<a " * n, "<script>x" * n, "<table>" + "<td><b>" * n + "<tr>" * n)
        began = time.process_time()
        for s in shapes:
            h.parse(s)
        return time.process_time() - began

    took(1000)
    assert took(40000) < 20 * max(took(4000), 0.02)


def test_deep_and_wide_pages_are_whole():
    trees = h.trained()
    deep = "<article>" + "<div>" * 3000 + "<p>" + "Some words of an article here. " * 50 + "</p>" + "</div>" * 3000 + "</article>"
    wide = "<article>" + "".join(f"<p>Words of paragraph {k} stand here.</p>" for k in range(30000)) + "</article>"
    assert list(h.main_texts([deep, wide], trees))[1] == " ".join(f"Words of paragraph {k} stand here." for k in range(30000))
    one, page = h.features([h.parse(wide)]), h.parse(wide)
    assert (np.concatenate(list(h.feature_blocks([page], 1000))) == one).all()
    assert "inside" in h.main_text("<article><h1>A title of it</h1><p>Text <noscript>inside</noscript> and <canvas>there</canvas>, some more words.</p></article>", trees)


def test_edges(spark):
    long = "<article><h1>Title here</h1>" + "<p>Some words of an article &eacute;.</p>" * 20000 + "</article>"
    page = "<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>The  title</h1><p>One\n two.</p><p>Three &#38; four, and some more words to read.</p></article><footer>&copy; me</footer></body>"
    rows = [(1, "u", page, 9), (2, None, None, 9), (3, "u", "", 9), (4, "u", long, 9), (1, "u", page, 9), (5, "u", "<", 9), (6, "u", "<script>x", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = h.extract(pages).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 7 and by[1]["text"] == "The title One two. Three & four, and some more words to read."
    assert [by[k]["text"] for k in (2, 3, 6)] == ["", "", ""]
    assert by[4]["n_chars"] == len("Title here") + 20000 * (1 + len("Some words of an article é."))
    assert h.extract(pages.where("false")).count() == 0


def test_a_slash_closes_nothing_but_foreign_elements():
    shown = lambda source: " ".join(t for t, *_ in h.parse(source).texts if t.strip())
    assert "alert" not in shown("<p>one<script src=/a/>alert(1)</script>two</p>")
    assert "color" not in shown("<p>one<style type=text/>p{color:red}</style>two</p>")
    assert shown("<p>a<svg><path d=''/><g/></svg>b</p>").replace(" ", "") == "ab"
    assert shown("<p>a<svg/>b</p><p>c</p>").replace(" ", "") == "abc"
    page = h.parse("<div class=article/><p>inside</p></div><p>after</p>")
    assert [n.name for n in page.nodes[:3]] == ["#root", "div", "p"] and page.nodes[2].parent is page.nodes[1]
    assert shown("<p>x<br/>y<img src=a.png/>z</p>").replace(" ", "") == "xyz"
