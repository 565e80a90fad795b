"""Word counts over conversations: the minimum query of the engine, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.session import table


def token_rows(messages: DataFrame, *keys: str) -> DataFrame:
    """One row for each word of each message: the keys, its place `pos` and the normalised `word`."""
    return messages.select(*keys, F.posexplode(T.tokens(F.col("text"))).alias("pos", "raw")).select(
        *keys, "pos", T.normalized(F.col("raw")).alias("word")
    )


def word_top120(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    words = token_rows(messages, "conv_id", "turn").where(T.acceptable(F.col("word")))
    per_message = words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    return (
        per_message.groupBy("word")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_messages"))
        .where(F.col("n") >= 2)
        .orderBy(F.desc("n"), "word")
        .limit(120)
    )


SQL_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
SQL_PATTERN = T.WORD_PATTERN.replace("'", "''")


def sql_tokens(source: str, keys: str, where: str = "true") -> str:
    """DuckDB: one row for each word, as token_rows() has them."""
    return f"""select {keys}, generate_subscripts(ws, 1) - 1 as pos, lower(unnest(ws)) as word from (
        select {keys}, list_filter(regexp_extract_all(coalesce(text, ''), '{SQL_PATTERN}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) as ws
        from {source} where {where})"""


SQL_ACCEPT = f"length(word) >= 2 and word not in ({SQL_STOP}) and not regexp_full_match(word, '[0-9.,:%/-]+')"

QUERIES = {"word_top120": word_top120}
ORACLES = {
    "word_top120": f"""with t as ({sql_tokens("conversations", "conv_id, turn", "role in ('user', 'assistant')")}),
        m as (select conv_id, turn, word, count(*) as n from t where {SQL_ACCEPT} group by all)
        select word, cast(sum(n) as bigint) as n, count(*) as n_messages from m group by word having sum(n) >= 2
        order by n desc, word limit 120"""
}
