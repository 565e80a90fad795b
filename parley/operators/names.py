"""Names: capitalised English words that are never written small, and short forms of full names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SINGLE_LEAST, PAIR_LEAST, FULL_LEAST, MOST_FULL = 4, 2, 3, 24
TOGETHER = 0.15


def english_names(texts: DataFrame, key: str = "id", single: int = SINGLE_LEAST, pair: int = PAIR_LEAST) -> DataFrame:
    """name, n: capitalised pairs at `pair` places or more, and capitalised words in mid-sentence at `single` places, of three
    letters or more, that no text writes in lower case."""
    words = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[.!?\n\"“”]"), F.lit(0))).alias("pos", "w"))
    row = Window.partitionBy(key).orderBy("pos")
    look = words.select(F.col("w"), F.lag("w").over(row).alias("before"), F.lead("w").over(row).alias("after"))
    small = words.where(F.col("w").rlike("^[a-z]+$")).select(F.col("w").alias("low")).distinct()
    proper = F.col("w").rlike("^[A-Z][a-z]{2,}$")
    inside = F.col("before").rlike("^[A-Za-z]+$")
    singles = look.where(proper & inside).groupBy(F.col("w").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= single)
    pairs = look.where(F.col("w").rlike("^[A-Z][a-z]+$") & F.col("after").rlike("^[A-Z][a-z]+$"))
    pairs = pairs.groupBy(F.concat_ws(" ", "w", "after").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= pair)
    free = singles.join(small, F.lower("name") == F.col("low"), "left_anti")
    parts = pairs.withColumn("low", F.lower(F.split("name", " ")[1])).join(small, "low", "left_anti").select("name", "n")
    return free.unionAll(parts)


def short_forms(full: DataFrame) -> DataFrame:
    """full -> full, alias: first and last names, with an honorific or a possessive."""
    first, last = F.split("full", " ")[0], F.element_at(F.split("full", " "), -1)
    made = F.array(first, last, *[F.concat_ws(" ", F.lit(h), last) for h in ("Mr", "Mrs", "Ms", "Dr")])
    return full.where(F.col("full").contains(" ")).select("full", F.explode(F.array_distinct(made)).alias("alias"))


def coreference(texts: DataFrame, full: DataFrame, key: str = "id") -> DataFrame:
    """full, alias, n: short forms that stand alone three times or more, belong to one full name only, and share messages
    with it. `full` (full, n) is cut to the MOST_FULL most frequent names, so the names' side of the join is bounded."""
    names = full.where(F.col("n") >= FULL_LEAST).orderBy(F.desc("n"), "full").limit(MOST_FULL).select("full")
    forms = short_forms(names)
    single = forms.groupBy("alias").agg(F.count("*").alias("owners")).where("owners = 1").select("alias")
    forms = forms.join(single, "alias")
    held = texts.join(F.broadcast(forms), F.col("text").contains(F.col("alias")))
    alone = F.regexp_replace("text", F.col("full"), F.lit(" "))
    uses = F.size(F.regexp_extract_all(alone, F.concat(F.lit(r"\b"), F.col("alias"), F.lit(r"\b")), F.lit(0)))
    counted = held.select("full", "alias", uses.alias("uses"), F.col("text").contains(F.col("full")).cast("int").alias("both"))
    totals = counted.where("uses > 0").groupBy("full", "alias").agg(F.sum("uses").alias("n"), F.count("*").alias("messages"), F.sum("both").alias("together"))
    of_full = texts.join(F.broadcast(names), F.col("text").contains(F.col("full"))).groupBy("full").agg(F.count("*").alias("full_messages"))
    joined = totals.join(of_full, "full")
    return joined.where((F.col("n") >= 3) & (F.col("together") / F.least("messages", "full_messages") >= TOGETHER)).select("full", "alias", "n")
