"""Community boards: leaderboards with Wilson bounds and a least number of contributors, over `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.session import table

Z = 1.96
MIN_CONTRIBUTORS = 5
SHOWN_KINDS = 8


def wilson(hits: Column, n: Column, sign: int, z: float = Z) -> Column:
    """The lower (-1) or upper (1) Wilson bound of a share."""
    p = hits / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (middle + sign * spread) / (1 + z * z / n)


def wilson_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of event, the share of events above the middle value, with bounds; kinds of few users are left out."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hits"), F.count_distinct("user_id").alias("contributors")
    )
    return rows.where(F.col("contributors") >= MIN_CONTRIBUTORS).select(
        "event_type", "n", "hits", "contributors",
        F.round(wilson(F.col("hits"), F.col("n"), -1), 6).alias("lower"), F.round(wilson(F.col("hits"), F.col("n"), 1), 6).alias("upper"),
    )


def k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with fewer distinct kinds of events than the threshold are folded into one row."""
    per_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    shown = F.when(F.col("n") >= MIN_CONTRIBUTORS, F.col("user_id"))
    return per_user.groupBy(shown.alias("shown_user")).agg(F.sum("n").alias("events"), F.count("*").alias("users"), F.max("kinds").alias("kinds"))


def kind_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kinds by hour of day, and the share of the rest."""
    counted = table(spark, sf_dir, "events").groupBy(F.concat_ws("/", "event_type", F.hour("ts")).alias("kind")).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "kind")))
    folded = ranked.groupBy(F.when(F.col("place") <= SHOWN_KINDS, F.col("kind")).otherwise("rest").alias("kind")).agg(F.sum("n").alias("n"))
    return folded.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_P = "(hits / n)"
_BOUND = f"round(({_P} + {Z * Z} / (2 * n) {{}} {Z} * sqrt(({_P} * (1 - {_P}) + {Z * Z} / (4 * n)) / n)) / (1 + {Z * Z} / n), 6)"

QUERIES = {"wilson_board": wilson_board, "k_anonymity": k_anonymity, "kind_fold": kind_fold}
ORACLES = {
    "wilson_board": f"""with r as (select event_type, count(*) as n, count(*) filter (value > 50) as hits, count(distinct user_id) as contributors from events group by 1)
        select event_type, n, hits, contributors, {_BOUND.format("-")} as lower, {_BOUND.format("+")} as upper from r where contributors >= {MIN_CONTRIBUTORS}""",
    "k_anonymity": f"""with u as (select user_id, count(*) as n, count(distinct event_type) as kinds from events group by 1)
        select case when n >= {MIN_CONTRIBUTORS} then user_id end as shown_user, cast(sum(n) as bigint) as events, count(*) as users, max(kinds) as kinds from u group by 1""",
    "kind_fold": f"""with c as (select event_type || '/' || hour(ts) as kind, count(*) as n from events group by 1), r as (select *, row_number() over (order by n desc, kind) as place from c),
        f as (select case when place <= {SHOWN_KINDS} then kind else 'rest' end as kind, cast(sum(n) as bigint) as n from r group by 1) select kind, n, round(n / sum(n) over (), 6) as share from f""",
}
