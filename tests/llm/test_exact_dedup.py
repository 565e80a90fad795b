import hashlib
import random
import re

from pyspark.sql import functions as F

from parley.llm import exact_dedup as e

SCHEMA = "doc_id long, text string, digest string, file int, kept string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for content, members in groups.items():
        first = min(members)
        keep = None if first[1] else first[2]
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(None if m[1] else m[2], keep, len(members), m is first or m == first, sha) for m in members]
    return sorted(out, key=repr)


def made(seed=3):
    rng = random.Random(seed)
    base = ["alpha beta", "é x", "  ", "", None, "x" * 50_000, "one\ttwo\r\nthree\x0b\x0c", "long " * 3000]
    rows = [(k, rng.choice(["", " ", "\n\t"]).join(rng.choice(base) or "" for _ in range(rng.randint(1, 2)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(base)] + [(200 + k, "alphabeta") for k in range(70)] + [(None, "alone"), (None, "al one"), (300, "alone ")]
    return rows


def written(spark, rows, path, mode="append"):
    wide = [(i, t, "clash", 1, "clash") for i, t in rows]
    spark.createDataFrame(wide, SCHEMA).coalesce(2).write.mode(mode).parquet(path)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_brute_force_and_later_files_meet_the_state(spark, tmp_path):
    rows, path, folder = made(), str(tmp_path / "docs"), str(tmp_path / "state")
    written(spark, rows[:70], path)
    assert told(e.deduplicated(spark, path, folder)) == brute(rows[:70])
    written(spark, rows[70:], path)
    assert told(e.deduplicated(spark, path, folder)) == brute(rows)
    assert told(e.deduplicated(spark, path, folder)) == brute(rows)  # nothing new has arrived


def test_colliding_digests_are_told_apart_by_their_bytes(spark, tmp_path):
    rows, path = made(5), str(tmp_path / "docs")
    written(spark, rows, path)
    run = e.ExactDedup(spark, path, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1).cast("binary"), bytes_a_core=1)
    run.take()
    assert not run.collided(run.state().where("size > 1")).isEmpty()
    got = sorted((tuple(r)[:4] for r in run.result().collect()), key=repr)
    assert got == sorted((r[:4] for r in brute(rows)), key=repr)


def test_repeated_ids_keep_one_row(spark, tmp_path):
    path = str(tmp_path / "docs")
    written(spark, [(7, "same"), (7, "same"), (7, "other")], path)
    got = told(e.deduplicated(spark, path))
    assert [(r[1], r[2], r[3]) for r in got if r[2] == 2] == [(7, 2, False), (7, 2, True)] and len(got) == 3


def test_empty(spark, tmp_path):
    path = str(tmp_path / "docs")
    written(spark, [], path)
    assert e.deduplicated(spark, path).count() == 0
