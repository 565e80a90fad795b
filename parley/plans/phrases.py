"""Phrase discovery: neighbours that keep each other's company, and how freely they stand among others.

The engine's rule speaks of Han tokens; here it is applied to the tokens of any script, so that the tables exercise it. The
rule for Han is `parley.operators.phrases.discover`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import names as N
from parley.operators import phrases as P
from parley.plans.words import SQL_STOP, sql_tokens, token_rows
from parley.session import table

COHESION, LEAST = 0.30, 4


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = token_rows(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")
    row = Window.partitionBy("doc_id").orderBy("pos")
    return words.select("doc_id", "pos", "word", F.lead("word").over(row).alias("next"), F.lag("word").over(row).alias("before"), F.lead("word", 2).over(row).alias("after"))


def bigram_cohesion(spark, sf_dir):
    """Pairs without function words that make up a good share of the uses of their more frequent part."""
    rows = _adjacent(spark, sf_dir)
    counts = rows.groupBy("word").agg(F.count("*").alias("n_word"))
    free = ~F.col("word").isin(T.STOP_WORDS) & ~F.col("next").isin(T.STOP_WORDS)
    pairs = rows.where(free).groupBy("word", "next").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    parts = pairs.join(counts, "word").join(counts.select(F.col("word").alias("next"), F.col("n_word").alias("n_next")), "next")
    share = F.round(F.col("n") / F.greatest("n_word", "n_next"), 6)
    return parts.select("word", "next", "n", share.alias("cohesion")).where(F.col("cohesion") >= COHESION)


def branching_entropy(spark, sf_dir):
    """For each such pair and side: how often it stands at an edge or beside a function word, and the neighbours' entropy."""
    rows = _adjacent(spark, sf_dir)
    pairs = bigram_cohesion(spark, sf_dir).select("word", "next")
    held = rows.join(pairs, ["word", "next"])
    sides = held.select("word", "next", F.lit("left").alias("side"), F.coalesce("before", F.lit("")).alias("beside")).unionAll(
        held.select("word", "next", F.lit("right").alias("side"), F.coalesce("after", F.lit("")).alias("beside"))
    )
    counted = sides.groupBy("word", "next", "side", "beside").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("word", "next", "side"))
    shares = counted.withColumn("p", F.col("n") / total)
    edge = (F.col("beside") == "") | F.col("beside").isin(T.STOP_WORDS)
    return shares.groupBy("word", "next", "side").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.when(edge, F.col("p")).otherwise(0.0)), 6).alias("edge_share"), F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy")
    )


_ROWS = f"""t as ({sql_tokens("documents", "doc_id", "lang = 'en'")}), r as (select *, lead(word) over w as next, lag(word) over w as before, lead(word, 2) over w as after from t window w as (partition by doc_id order by pos)),
    counts as (select word, count(*) as n_word from r group by 1),
    pairs as (select word, next, count(*) as n from r where word not in ({SQL_STOP}) and next not in ({SQL_STOP}) group by all having count(*) >= {LEAST}),
    held as (select pairs.word, pairs.next, n, round(n / greatest(a.n_word, b.n_word), 6) as cohesion from pairs join counts a on a.word = pairs.word join counts b on b.word = pairs.next),
    good as (select * from held where cohesion >= {COHESION})"""

def lexicon_merge(spark, sf_dir):
    """Tokens of each English document before and after merging by the pairs that cohere."""
    words = bigram_cohesion(spark, sf_dir).select(F.concat_ws(" ", "word", "next").alias("word"))
    texts = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text")
    plain = texts.select("id", F.aggregate(F.transform(P.chunks(F.col("text")), lambda c: F.size(c)), F.lit(0), lambda a, b: a + b).alias("n_tokens"))
    return P.merge(texts, words).select("id", F.size("tokens").alias("n_merged")).join(plain, "id")


def english_names(spark, sf_dir):
    return N.english_names(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text"))


QUERIES = {"bigram_cohesion": bigram_cohesion, "branching_entropy": branching_entropy, "lexicon_merge": lexicon_merge, "english_names": english_names}
ORACLES = {
    "bigram_cohesion": f"with {_ROWS} select * from good",
    "branching_entropy": f"""with {_ROWS}, s as (select word, next, 'left' as side, coalesce(before, '') as beside from r join good using (word, next) union all select word, next, 'right', coalesce(after, '') from r join good using (word, next)),
        c as (select word, next, side, beside, count(*) as n from s group by all), p as (select *, n / sum(n) over (partition by word, next, side) as p from c)
        select word, next, side, cast(sum(n) as bigint) as n, round(sum(case when beside = '' or beside in ({SQL_STOP}) then p else 0.0 end), 6) as edge_share, round(-sum(p * ln(p)), 6) as entropy from p group by all""",
}
