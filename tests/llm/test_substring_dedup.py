import hashlib
import random
import re

from parley.llm import substring_dedup as s


def brute(rows):
    """(doc_id, n_words, n_removed, kept_sha256) of each row, by the wording."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "a b"]
    passages = [rng.choices(vocabulary, k=rng.randint(12, 40)) for _ in range(6)]
    rows = []
    for k in range(n):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((k * 3 % (3 * n), rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000 + k, rows[5][1]) for k in range(20)] + [(2000, None), (2001, ""), (7001, "only twelve words " * 4), (7002, "only twelve words " * 4)]
    rows += [(7003, "again and again " * 6), (7003, "again and again " * 6), (7004, "x " * 3000), (7005, "x " * 14)]
    return rows


def test_equals_brute_force_in_any_number_of_batches(spark):
    rows = made(2)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, first string")
    for batches in (1, 2, 5):
        index = s.FingerprintIndex(spark, buckets=3, fan=2)
        got = sorted(tuple(r) for r in s.removed(docs, batches, index).collect())
        assert got == brute(rows)
        assert len(index.runs) <= 3
        index.drop()


def test_later_calls_see_the_history(spark):
    rows = made(5)
    ids = sorted({r[0] for r in rows})
    index = s.FingerprintIndex(spark, buckets=3, fan=2)
    got = []
    for k in range(3):  # disjoint documents of rising id; the last part holds copies of texts of the first
        low, high = ids[len(ids) * k // 3], ids[len(ids) * (k + 1) // 3 - 1]
        docs = spark.createDataFrame([r for r in rows if low <= r[0] <= high], "doc_id long, text string")
        got += [tuple(r) for r in s.removed(docs, 1 + k % 2, index).collect()]
    assert sorted(got) == brute(rows)
    assert any(i >= 1000 and n == gone > 12 for i, n, gone, _ in got)
    index.drop()


def test_the_query_merges_runs_and_keeps_null_ids(spark, monkeypatch):
    merged = []
    new = s.FingerprintIndex.new
    monkeypatch.setattr(s.FingerprintIndex, "new", lambda self, level=0: (merged.append(level), new(self, level))[1])
    rows = made(7)
    docs = spark.createDataFrame([*rows, (None, rows[5][1])], "doc_id long, text string")
    got = [tuple(r) for r in s.removed(docs).collect()]
    assert merged == [0, 0, 1, 0]  # the third batch meets a merged run
    n, text = len(re.findall(r"[^\x20\x09-\x0D]+", rows[5][1])), " ".join(re.findall(r"[^\x20\x09-\x0D]+", rows[5][1]))
    assert [r for r in got if r[0] is None] == [(None, n, 0, hashlib.sha256(text.encode()).hexdigest())]
    assert sorted(r for r in got if r[0] is not None) == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.removed(docs).count() == 0


def test_regular_words_that_differ_stay_apart(spark):
    """Two words of 1024 characters that every polynomial modulo a power of two takes for one."""
    flips = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = flips.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([*(f"w{j}" for j in range(7)), word, *(f"x{j}" for j in range(7))])) for k, word in enumerate((flips, other))]
    rows += [(2, rows[0][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in s.removed(docs).collect())
    assert got == brute(rows) and [r[2] for r in got] == [0, 0, 15]


def test_very_long_texts_and_other_ids(spark):
    long = " ".join(f"w{k * 7 % 5003}" for k in range(120_000))
    rows = [(5, long), (6, "before " + long), (7, "z" * 3_000_000 + " " + " ".join("abcdefghijklmn"))]
    docs = spark.createDataFrame([(i, t, 0, "k", [1]) for i, t in rows], "doc_id int, text string, place int, key string, marks array<int>")
    assert sorted(tuple(r) for r in s.removed(docs).collect()) == brute(rows)
