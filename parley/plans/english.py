"""Queries over English inflection, on the English documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import english as E
from parley.plans.words import SQL_ACCEPT, sql_tokens
from parley.session import cut, table


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n: all acceptable words of the English documents."""
    return T.counted(table(spark, sf_dir, "documents").where("lang = 'en'"))


def possessive_fold(spark, sf_dir):
    """Every third word is made a possessive first, as the documents hold none."""
    words = vocabulary(spark, sf_dir).withColumn("word", F.when(F.col("n") % 3 == 0, F.concat("word", F.lit("'s"))).when(F.col("word").endswith("s"), F.concat("word", F.lit("’"))).otherwise(F.col("word")))
    return words.groupBy(F.coalesce(E.possessive_base(F.col("word")), F.col("word")).alias("word")).agg(F.sum("n").alias("n"))


def base_forms(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("word", F.explode(E.base_forms(F.col("word"))).alias("base"))


def lemma_counts(spark, sf_dir):
    counts = cut(vocabulary(spark, sf_dir))  # the vocabulary is met several times
    plan = E.merge_plan(counts, T.STOP_WORDS)
    folded = counts.join(plan, "word", "left").select(F.coalesce("form", "word").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return folded.where(~F.col("word").isin(T.STOP_WORDS))


_VOCABULARY = f"""t as ({sql_tokens("documents", "doc_id", "lang = 'en'")}), v as (select word, count(*) as n from t where {SQL_ACCEPT} group by 1)"""
_OWNER = "case when word like '%''s' or word like '%’s' then left(word, length(word) - 2) when word like '%s''' or word like '%s’' then left(word, length(word) - 1) end"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _sql_bases() -> str:
    found = [_OWNER]
    for ending, least, instead in E.ENDINGS:
        holds, stem = f"word like '%{ending}' and length(word) >= {least} and word not like '%ss'", f"left(word, length(word) - {len(ending)})"
        found += [f"case when {holds} then {stem} || '{x}' end" for x in instead]
        if ending in E.DOUBLING:
            found.append(f"case when {holds} and right({stem}, 1) = left(right({stem}, 2), 1) and not regexp_matches({stem}, '[aeiou]$') then left({stem}, length({stem}) - 1) end")
    return ", ".join(found)


def _sql_candidates(v: str) -> str:
    """DuckDB: word, n, base, owner of a table of word, n."""
    return f"""select distinct word, n, unnest(list_filter([{_sql_bases()}],
        lambda x: x is not null)) as base, {_OWNER} as owner from {v} where length(word) >= 4"""


def sql_folded(v: str) -> str:
    """DuckDB: `bases` (word, n, base, owner) that a table of word, n folds onto, and `folded`, its counts by form."""
    return f"""b as ({_sql_candidates(v)} and word not like '%eed'), bases as (select * from b where base != word and regexp_matches(base, '[aeiouy]|[^a-z]')),
        worth as (select bases.*, v.n as n_base, count(*) over (partition by base) as n_forms, sum(bases.n) over (partition by base) + coalesce(v.n, 0) as total from bases left join {v} v on v.word = base),
        good as (select * from worth where (n_base is not null and word like '%s') or base in ({_STOPS}) or n_forms >= 2 or owner = base),
        chosen as (select * from good qualify row_number() over (partition by word order by coalesce(owner = base, false) desc, total desc, base) = 1),
        members as (select word, base, n from chosen union all select v.word, v.word, v.n from {v} v where v.word in (select base from chosen)),
        shown as (select base, arg_min(word, (-n, length(word), word)) as shown from members group by base),
        plan as (select word, case when coalesce(owner = base, false) or base in ({_STOPS}) then base else shown end as form from chosen join shown using (base)),
        folded as (select coalesce(form, word) as word, cast(sum(n) as bigint) as n from {v} left join plan using (word) group by 1)"""


QUERIES = {"possessive_fold": possessive_fold, "base_forms": base_forms, "lemma_counts": lemma_counts}
ORACLES = {
    "possessive_fold": f"""with {_VOCABULARY}, p as (select case when n % 3 = 0 then word || '''s' when word like '%s' then word || '’' else word end as word, n from v)
        select coalesce({_OWNER}, word) as word, cast(sum(n) as bigint) as n from p group by 1""",
    "base_forms": f"with {_VOCABULARY}, b as ({_sql_candidates('v')}) select word, base from b where base != word",
    "lemma_counts": f"with {_VOCABULARY}, {sql_folded('v')} select * from folded where word not in ({_STOPS})",
}
