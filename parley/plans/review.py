"""Queries over a finished word table and over small sources: flags, review, audits, names, Markdown logs, split tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import phrases as P
from parley.operators import review as R
from parley.plans.chats import _SOURCE, jsonl_files
from parley.plans.kinds import _BASE, _typed
from parley.plans.similarity import _ALL, _all_words
from parley.session import table
from parley.sources import chats as S

LISTED = (("clown", "mild", 0), ("stern", "strong", 1), ("ernst", "odd", 2), ("an", "never", 3), ("q", "odd", 4), ("z", "odd", 5))
FLAGS = ("mild", "strong", "odd", "never", R.MAYBE, "unused")
FILLER = ("the", "of", "and", "les", "die", "und", "bread")
FAMILIES = {"number": "^[0-9]+$", "mark": "[#*_|]", "single": "^.$", "address": "@|www"}
TOP, NEEDLE, FOLD = 60, "un", ("äöü", "aou")
ALIASES, GROUPS, PARTED = (("the", "of"),), (("of", "and"), ("of", "the"), ("der", "die"), ("der", "nowhere"), ("den", "das")), (("den",),)


def _listed(spark):
    return spark.createDataFrame(LISTED, "entry string, flag string, place long")


def flag_words(spark, sf_dir):
    return R.flag_words(_all_words(spark, sf_dir), _listed(spark)).where("flag is not null").select("word", "n", "flag")


def flag_counts(spark, sf_dir):
    return R.flag_counts(flag_words(spark, sf_dir), list(FLAGS))


def review_filter(spark, sf_dir):
    words = _typed(spark, sf_dir).select("word", "n", F.col("tags.kind").alias("kinds"))
    return R.review(words, "plain", NEEDLE, FOLD).select("word", "n")


def contribution_top(spark, sf_dir):
    typed = R.flag_words(_typed(spark, sf_dir).select("word", "n", "kind"), _listed(spark))
    return R.contribution(typed.withColumn("priority", F.col("word") == "the"))


def junk_rate(spark, sf_dir):
    return R.junk_rate(_all_words(spark, sf_dir), spark.createDataFrame([(w,) for w in FILLER], "word string"), TOP)


def contaminant_audit(spark, sf_dir):
    """The documents' words hold none, so a few are mixed in."""
    mixed = spark.createDataFrame([("12", 10**9), ("a|b", 10**9 + 1), ("x@y", 10**9 + 2), ("fine", 10**9 + 3)], "word string, n long")
    return R.contaminants(_all_words(spark, sf_dir).unionAll(mixed), FAMILIES, TOP)


def coref_alias(spark, sf_dir):
    groups = R.known_groups(spark.createDataFrame(GROUPS, "full string, alias string"), _all_words(spark, sf_dir))
    return R.coref_aliases(groups, spark.createDataFrame(ALIASES, "source string, target string"), spark.createDataFrame(PARTED, "full string"))


def collect_names(spark, sf_dir):
    rows = S.records(jsonl_files(spark, sf_dir))
    return R.names_of(S.messages(rows), S.chats(rows), most=20)


def all_swipes(spark, sf_dir):
    return S.messages(S.records(jsonl_files(spark, sf_dir)), all_swipes=True).select("source", "index", "raw")


def markdown_turns(spark, sf_dir):
    """Conversations of user and assistant as a Markdown log, with a preface."""
    rows = table(spark, sf_dir, "conversations").where("role != 'system'")
    head = F.concat(F.lit("## "), F.col("turn").cast("string"), F.when(F.col("role") == "user", " U").otherwise(" A"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    said = rows.select(F.col("conv_id").cast("string").alias("source"), "turn", F.posexplode(F.split(head, "\n")).alias("k", "line"))
    preface = rows.select(F.col("conv_id").cast("string").alias("source")).distinct().select("source", F.lit(-1).cast("long").alias("line_no"), F.lit("# A log").alias("line"))
    return S.markdown_turns(said.select("source", (F.col("turn") * 100000 + F.col("k")).alias("line_no"), "line").unionAll(preface))


def external_tokens(spark, sf_dir):
    """Texts that were split at blanks, in chunks between tokens of marks alone."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    return P.chunks_of_tokens(rows).groupBy("id").agg(F.max("chunk").alias("last_chunk"), F.max("pos").alias("longest"), F.count("*").alias("tokens"))


QUERIES = {
    "flag_words": flag_words, "flag_counts": flag_counts, "review_filter": review_filter, "contribution_top": contribution_top, "junk_rate": junk_rate, "contaminant_audit": contaminant_audit,
    "coref_alias": coref_alias, "collect_names": collect_names, "all_swipes": all_swipes, "markdown_turns": markdown_turns, "external_tokens": external_tokens,
}
_LISTED = "(values " + ", ".join(repr(x) for x in LISTED) + ") l(entry, flag, place)"


def _flagged(words: str) -> str:
    return f"""met as (select word, case when length(entry) = 1 and word != entry then '{R.MAYBE}' else flag end as flag, case when length(entry) = 1 and word != entry then place + 1048576 else place end as p
        from {words} join {_LISTED} on word = entry or (length(entry) >= 3 and contains(lower(word), entry)) or (length(entry) = 1 and length(word) = 2 and contains(lower(word), entry))),
        first as (select word, arg_min(flag, p) as flag from met group by 1)"""


ORACLES = {
    "flag_words": f"with {_ALL}, {_flagged('w')} select word, n, flag from w join first using (word)",
    "flag_counts": f"with {_ALL}, {_flagged('w')}, f as (select unnest([{', '.join(repr(f) for f in FLAGS)}]) as flag) select f.flag, count(first.word) as words from f left join first on f.flag = first.flag group by 1",
    "review_filter": f"with {_BASE} select word, n from kinds where list_contains(tags, 'plain') and (contains(lower(word), '{NEEDLE}') or contains(translate(lower(word), '{FOLD[0]}', '{FOLD[1]}'), '{NEEDLE}'))",
    "contribution_top": f"with {_BASE}, {_flagged('kinds')} select word, n, kind from kinds left join first using (word) where kind not in ('person', 'generic') and flag is null and word != 'the' and n >= 2 order by n desc, word limit {R.MOST_SHARED}",
    "junk_rate": f"with {_ALL}, top as (select word from w order by n desc, word limit {TOP}) select count(*) as words, round(count(*) filter (word in ({', '.join(repr(f) for f in FILLER)})) / count(*), 6) as rate from top",
    "contaminant_audit": f"""with {_ALL}, every as (select word, n from w union all select * from (values ('12', 1000000000::bigint), ('a|b', 1000000001), ('x@y', 1000000002), ('fine', 1000000003)) x(word, n)),
        top as (select word from every order by n desc, word limit {TOP}) """
    + " union all ".join(f"select '{name}' as family, word from top where regexp_matches(word, '{p}')" for name, p in FAMILIES.items()),
    "coref_alias": f"""with {_ALL}, g as (select * from (values {', '.join(repr(x) for x in GROUPS)}) g("full", alias)), k as (select * from g where "full" in (select word from w) and alias in (select word from w))
        select 'the' as source, 'of' as target union all select alias, "full" from k where "full" != 'den' and alias != 'the'""",
    "collect_names": f"""with n as (select 'name of ' || role as name from conversations union all select 'Me' union all select 'card ' || (conv_id % 5) from conversations),
        b as (select name from n union all select trim(regexp_replace(name, '(?i)\\s*[-_ ]?\\(?v?[0-9]+(\\.[0-9]+)*\\)?$', '')) from n) select distinct name from b where length(name) between 2 and 20""",
    "all_swipes": f"select {_SOURCE} as source, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as index, text || chr(10) || 'other' as raw from conversations",
    "markdown_turns": r"""select cast(conv_id as varchar) as source, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as index, case when role = 'user' then 'user' else 'char' end as role,
        regexp_replace(trim(chr(10) || text || chr(10)), '^\n+|\n+$', '', 'g') as raw from conversations where role != 'system'""",
    "external_tokens": r"""with t as (select doc_id as id, string_split(text, ' ') as ts from documents), e as (select id, generate_subscripts(ts, 1) as k, unnest(ts) as token from t),
        c as (select *, regexp_matches(token, '[\p{L}\p{N}]') as word, sum(case when regexp_matches(token, '[\p{L}\p{N}]') then 0 else 1 end) over (partition by id order by k) as chunk from e),
        p as (select id, dense_rank() over (partition by id order by chunk) - 1 as chunk, row_number() over (partition by id, chunk order by k) - 1 as pos from c where word)
        select id, cast(max(chunk) as int) as last_chunk, cast(max(pos) as int) as longest, count(*) as tokens from p group by 1""",
}
