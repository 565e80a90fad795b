"""What users change after the analysis: priorities, aliases, display and kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

MOST_PRIORITY, LONGEST = 50, 32


def parse_priority(text: Column) -> Column:
    """The items of a priority line in order: parted by semicolons, trimmed, the first of equal ones, at most MOST_PRIORITY."""
    items = F.filter(F.transform(F.split(text, "[;；]"), lambda x: F.trim(F.translate(x, "　", " "))), lambda x: (x != "") & (F.length(x) <= LONGEST))
    first = F.filter(items, lambda x, k: F.array_position(F.transform(items, lambda y: F.lower(y)), F.lower(x)) == k + 1)
    return F.slice(first, 1, MOST_PRIORITY)


def apply_priority(words: DataFrame, priority: DataFrame) -> DataFrame:
    """word, n and place, item (a bounded list) -> word, n (double), priority: n of the i-th item is max * (1 + (k - i) / k)."""
    most = words.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most"))
    k = F.count("*").over(Window.partitionBy())
    scaled = priority.withColumn("k", k).crossJoin(most).select("item", (F.col("most") * (1 + (F.col("k") - F.col("place")) / F.col("k"))).alias("value"), F.lower("item").alias("key"))
    joined = words.withColumn("key", F.lower("word")).join(scaled, "key", "full")
    return joined.select(F.coalesce("word", "item").alias("word"), F.coalesce("value", F.col("n").cast("double")).alias("n"), F.col("value").isNotNull().alias("priority"))


def alias_closure(aliases: DataFrame, hops: int = 16) -> DataFrame:
    """source, target (one target for each source) -> source, final: the end of each chain; sources on or before a cycle
    are left out. Each round doubles how far all chains are followed."""
    steps = cut(aliases.select(F.lower("source").alias("source"), F.lower("target").alias("final")))
    for _ in range(hops):
        far = steps.select(F.col("source").alias("final"), F.col("final").alias("further"))
        next_steps = cut(steps.join(far, "final", "left").select("source", F.coalesce("further", "final").alias("final")))
        if next_steps.exceptAll(steps).isEmpty():
            break
        steps = next_steps
    ends = steps.select("source").distinct().withColumnRenamed("source", "final")
    return steps.join(ends, "final", "left_anti").select("source", "final")


def apply_aliases(words: DataFrame, aliases: DataFrame) -> DataFrame:
    """word, n -> word, n with the counts of aliases moved to the ends of their chains, where these are in the table."""
    ends = alias_closure(aliases).join(words.select(F.lower("word").alias("final")).distinct(), "final", "left_semi")
    keyed = words.withColumn("source", F.lower("word")).join(ends, "source", "left")
    totals = keyed.groupBy(F.coalesce("final", "source").alias("source")).agg(F.sum("n").alias("n"))
    return keyed.where("final is null").select("word", "source").join(totals, "source").select("word", "n").where("n > 0")


def displayed(word: Column, script: tuple[str, str] = ("", ""), own: Column | None = None) -> Column:
    """What a word is shown as: the user's own form, else the word in another script, character by character."""
    other = F.translate(word, *script) if script[0] else word
    return other if own is None else F.coalesce(own, other)
