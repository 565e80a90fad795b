"""Kinds, buckets and blocklists over the words of the documents, into which a few words of known kinds are mixed."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import kinds as K
from parley.plans.similarity import _ALL, _all_words
from parley.plans.words import SQL_STOP

EXTRA = ("今天", "十年", "生日", "走路", "一路", "王先生", "茶", "对面", "春节", "关节", "问道", "3rd", "10:30", "三个", "朝阳区", "小区", "合同", "today", "bread", "sir", "red", "kitchen", "river", "tea", "sword", "monday", "mother", "company", "wind")
BASELINE, LISTED = ["is", "thin", "clown"], (("the", "manual"), ("of", "manual"), ("and", "auto"), ("queue", "auto"))
SHOWN, MOST = ["plain", "time", "food"], 50
KINDS = (("the", "time"), ("and", "place"), ("bread", "place"))


def _words(spark, sf_dir):
    extra = spark.createDataFrame([(w, 100 + k) for k, w in enumerate(EXTRA)], "word string, n long")
    return _all_words(spark, sf_dir).join(extra, "word", "left_anti").unionAll(extra)


def _typed(spark, sf_dir):
    return K.typed(_words(spark, sf_dir)).withColumn("kind", F.col("tags")[0]["kind"])


def kinds(spark, sf_dir):
    return _typed(spark, sf_dir).select("word", "n", "kind")


def kind_buckets(spark, sf_dir):
    return _typed(spark, sf_dir).groupBy(K.bucket(F.col("kind")).alias("bucket")).agg(F.count("*").alias("words"), F.sum("n").alias("uses"))


def words_by_kind(spark, sf_dir):
    """Words of each kind by any tag, kinds without words included."""
    tags = _typed(spark, sf_dir).select(F.explode("tags.kind").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(k,) for k in sorted({*K.CONF, "plain"})], "kind string")
    return every.join(tags, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def visible_words(spark, sf_dir):
    generic = K.mark_generic(F.col("tags"), F.col("n") % 2 == 0)
    return _typed(spark, sf_dir).withColumn("tags", generic).where(K.visible(F.col("tags"), SHOWN)).select("word", "n")


def blocklist_apply(spark, sf_dir):
    listed = spark.createDataFrame(LISTED, "word string, reason string")
    return K.block(_words(spark, sf_dir), BASELINE, listed).where("reason is null").select("word", "n")


def blocklist_summary(spark, sf_dir):
    listed = spark.createDataFrame(LISTED, "word string, reason string")
    blocked = K.block(_words(spark, sf_dir), BASELINE, listed).where("reason is not null and reason != 'baseline'")
    return blocked.groupBy("reason").agg(F.count("*").alias("words"), F.min("word").alias("sample"))


def kind_refile(spark, sf_dir):
    return K.refile(_typed(spark, sf_dir).select("word", "n", "kind"), spark.createDataFrame(KINDS, "word string, kind string"), SHOWN, MOST)


def _test(kind: str) -> str:
    """DuckDB: whether a word has a kind."""
    rows = [x for x in K.rule_rows() if x[0] == kind]
    of = lambda how: [v for _, h, v, _ in rows if h == how]
    tests = [f"regexp_matches(word, '{p}')" for k, p in K.PATTERNS if k == kind]
    if of("word"):
        tests.append("word in (" + ", ".join(f"'{w}'" for w in of("word")) + ")")
    if of("end"):
        but = "".join(f" and word != '{w}'" for w in of("but"))
        tests.append(f"((" + " or ".join(f"ends_with(word, '{e}')" for e in of("end")) + f") and length(word) >= {rows[0][3]} and not regexp_matches(word, '{K.COUNTED}') and word not in ({SQL_STOP}){but})")
    return " or ".join(tests)


def sql_typed(word: str) -> str:
    """DuckDB: the kinds of a word, strongest first."""
    order = sorted(K.CONF, key=lambda k: (-K.CONF[k], k))
    return "list_filter([" + ", ".join(f"case when {_test(k)} then '{k}' end" for k in order).replace("word", word) + "], lambda k: k is not null)"


_TAGS = sql_typed("word")
_EXTRA = ", ".join(f"('{w}', {100 + k}::bigint)" for k, w in enumerate(EXTRA))
_BASE = f"""{_ALL}, x as (select * from (values {_EXTRA}) x(word, n)), ws as (select word, n from w where word not in (select word from x) union all select * from x),
    g as (select word, n, {_TAGS} as found from ws), typed as (select word, n, case when list_contains(found, 'person') then ['person'] when len(found) > 0 then found else ['plain'] end as tags from g),
    kinds as (select word, n, tags, tags[1] as kind from typed)"""
_BUCKET = "case kind " + " ".join(f"when '{k}' then '{b}'" for k, b in sorted(K.BUCKETS.items())) + " else 'other' end"
_HELD = "word in (" + ", ".join(f"'{b}'" for b in BASELINE) + ")" + "".join(f" or contains(word, '{b}')" for b in BASELINE if len(b) >= 4)
_LIST = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in LISTED) + ") l(word, reason)"
_IN_SHOWN = ", ".join(f"'{k}'" for k in SHOWN)

QUERIES = {
    "kinds": kinds, "kind_buckets": kind_buckets, "words_by_kind": words_by_kind, "visible_words": visible_words, "blocklist_apply": blocklist_apply, "blocklist_summary": blocklist_summary, "kind_refile": kind_refile,
}
ORACLES = {
    "kinds": f"with {_BASE} select word, n, kind from kinds",
    "kind_buckets": f"with {_BASE} select {_BUCKET} as bucket, count(*) as words, cast(sum(n) as bigint) as uses from kinds group by 1",
    "words_by_kind": f"with {_BASE}, e as (select unnest([{', '.join(repr(k) for k in sorted({*K.CONF, 'plain'}))}]) as kind), c as (select unnest(tags) as kind, count(*) as n from kinds group by 1) select kind, coalesce(n, 0) as n from e left join c using (kind)",
    "visible_words": f"with {_BASE} select word, n from kinds where n % 2 = 1 and kind in ({_IN_SHOWN})",
    "blocklist_apply": f"with {_BASE} select word, n from ws left join {_LIST} using (word) where not ({_HELD}) and reason is null",
    "blocklist_summary": f"with {_BASE} select reason, count(*) as words, min(word) as sample from ws join {_LIST} using (word) where not ({_HELD}) group by 1",
    "kind_refile": f"with {_BASE}, u as (select * from (values {', '.join(repr(k) for k in KINDS)}) u(word, new)) select word, n, coalesce(new, kind) as kind from kinds left join u using (word) where coalesce(new, kind) in ({_IN_SHOWN}) order by n desc, word limit {MOST}",
}
