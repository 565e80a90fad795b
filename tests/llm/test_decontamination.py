import random

import numpy as np

from parley.llm import decontamination as d
from parley.llm.words import LetterRuns, utf8
import pyarrow as pa


def brute(a, b):
    """Smith-Waterman by its recurrence."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(5)
    ps = [rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    qs = [rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    score, first, last = d.align(ps, qs)
    assert score.tolist() == [brute(p.tolist(), q.tolist()) for p, q in zip(ps, qs)]
    for p, q, s, f, e in zip(ps, qs, score, first, last):
        assert s == 0 or brute(p[f : e + 1].tolist(), q.tolist()) == s


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for k in range(12)]
    docs = []
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randint(5, 80))
        if k % 3 == 0:
            copy = items[k % 12][1].split()
            for _ in range(rng.randint(0, len(copy) // 5)):
                place = rng.randrange(len(copy))
                copy[place : place + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[place], "more"]])
            words[3:3] = copy
        if k % 10 == 1:
            words[2:2] = items[k % 12][1].split()[:6]
        docs.append((k, " ".join(words).replace("w7 ", "W7, ")))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: t.lower().replace(",", "").split()
    want = {(k, i): brute(plain(t), plain(q)) / (2 * len(plain(q))) for k, t in docs for i, q in items}
    assert got == {k: v for k, v in want.items() if v >= d.AT}
    assert len(got) >= 50


def test_short_items_with_every_third_word_changed(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((9, 12, 15, 18, 20))]
    docs = []
    for k, text in items:
        for shift in range(3):
            words = [f"x{j}" if j % 3 == shift else w for j, w in enumerate(text.split())]
            docs.append((len(docs), "before it " + " ".join(words) + " and after"))
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in docs for k, q in items if brute(t.split(), q.split()) / (2 * len(q.split())) >= d.AT}
    assert got == want and len(want) >= 10


def test_edges(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "rare pair", 0), (5, item, 0)], "item_id long, text string, doc_id long")
    rows = [(1, f"before ONE two, three four five six seven eight nine ten. {'after ' * 50000}", 9), (2, None, 9), (3, "", 9), (4, "a rare Pair here", 9), (1, item, 9), (6, "one two three four", 9), (7, "one two thre four five six sevn eight nine ten", 9), (None, item, 9), (None, "nothing of it", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    got = sorted((r["doc_id"] or 0, r["item_id"], round(r["similarity"], 2)) for r in d.contaminated(docs, items).collect())
    assert got == [(0, 1, 1.0), (0, 5, 1.0), (1, 1, 1.0), (1, 1, 1.0), (1, 5, 1.0), (1, 5, 1.0), (4, 4, 1.0), (7, 1, 0.7), (7, 5, 0.7)]
    for block in (d.BLOCK, 8):
        assert sorted(r["doc_id"] or 0 for r in d.clean(docs, items, block=block).collect()) == [0, 2, 3, 6]
    assert d.clean(docs, items).columns == docs.columns
    assert d.contaminated(docs.where("false"), items).count() == 0
    assert d.contaminated(docs, items.where("false")).count() == 0
    small = sorted((r["doc_id"] or 0, r["item_id"], round(r["similarity"], 2)) for r in d.contaminated(docs, items, block=8).collect())
    assert small == got


def test_tokens():
    runs = LetterRuns(*utf8(pa.array(["Ab c1, É é", None, "x"], pa.large_string())), digits=True)
    assert runs.at.tolist() == [0, 4, 4, 5] and runs.hash[2] == runs.hash[3]


EDITS = {
    "every third changed": lambda w, new: [new() if k % 3 == 1 else x for k, x in enumerate(w)],
    "every fourth left out": lambda w, new: [x for k, x in enumerate(w) if k % 4],
    "a word in every second gap": lambda w, new: [y for k, x in enumerate(w) for y in ([x, new()] if k % 2 else [x])],
    "a word in every gap": lambda w, new: [y for x in w for y in (x, new())],
    "changed, left out and put in": lambda w, new: [y for k, x in enumerate(w) for y in ([new()] if k % 9 == 2 else [] if k % 9 == 5 else [x, new()] if k % 9 == 8 else [x])],
    "two thirds of it": lambda w, new: w[: max(3, 2 * len(w) // 3)],
    "nothing": lambda w, new: list(w),
}


def test_recall_against_the_alignment_of_everything(spark):
    """Edits spread evenly over items of any length, in speech with frequent words, against Smith-Waterman of all pairs."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    speech = lambda n: rng.choices(vocabulary, weights, k=n)
    new = lambda: rng.choices(vocabulary, weights)[0]
    items = [(k, " ".join(speech(n))) for k, n in enumerate((5, 8, 12, 16, 21, 24, 40, 60, 100, 200))]
    docs, kind = [], {}
    for name, edit in EDITS.items():
        for k, text in items:
            kind[len(docs)] = name
            docs.append((len(docs), " ".join(speech(20) + edit(text.split(), new) + speech(30))))
    docs += [(1000 + k, " ".join(speech(200))) for k in range(40)]
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    number = {w: k for k, w in enumerate(vocabulary)}
    code = lambda t: np.array([number[w] for w in t.split()], np.uint64)
    pairs = [(i, k) for i, _ in docs for k, _ in items]
    texts, sought = {i: code(t) for i, t in docs}, {k: code(t) for k, t in items}
    score = d.align([texts[i] for i, _ in pairs], [sought[k] for _, k in pairs])[0]
    want = {p for p, s in zip(pairs, score.tolist()) if s / (2 * len(sought[p[1]])) >= d.AT}
    assert got <= want
    missed = [(kind.get(i, "none"), len(sought[k])) for i, k in sorted(want - got)]
    assert len(got) >= 0.95 * len(want) and all(n < 10 for _, n in missed)
