"""English inflection: possessives, base forms, and folding of forms onto the most frequent one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings, the least length of a word that has one, and what may stand in its place in the base.
ENDINGS = (("s", 4, ("",)), ("es", 5, ("",)), ("ies", 5, ("y",)), ("ed", 5, ("", "e")), ("ied", 5, ("y",)), ("ing", 6, ("", "e")))
#: Endings before which a base may double its last letter.
DOUBLING = ("ed", "ing")


def possessive_base(word: Column) -> Column:
    """The owner of a possessive, or null."""
    return F.when(word.rlike("['’]s$"), F.regexp_replace(word, "['’]s$", "")).when(word.rlike("s['’]$"), F.regexp_replace(word, "['’]$", ""))


def base_forms(word: Column) -> Column:
    """Candidate base forms, without the word itself: whatever an ending may hide. Which of them count, the vocabulary decides."""
    found = [possessive_base(word)]
    for ending, least, instead in ENDINGS:
        holds = word.endswith(ending) & (F.length(word) >= least) & ~word.endswith("ss")
        stem = F.left(word, F.length(word) - len(ending))
        found += [F.when(holds, F.concat(stem, F.lit(x))) for x in instead]
        if ending in DOUBLING:
            twice = (F.right(stem, F.lit(1)) == F.left(F.right(stem, F.lit(2)), F.lit(1))) & ~stem.rlike("[aeiou]$")
            found.append(F.when(holds & twice, F.left(stem, F.length(stem) - 1)))
    kept = F.filter(F.array_distinct(F.array_compact(F.array(*found))), lambda b: b != word)
    return F.when(F.length(word) < 4, F.array().cast("array<string>")).otherwise(kept)


def folding_bases(word: Column) -> Column:
    """The base forms that merge_plan folds onto: none of words in -eed, and none without a vowel."""
    bases = F.filter(base_forms(word), lambda b: b.rlike("[aeiouy]|[^a-z]"))
    return F.when(word.endswith("eed"), F.array().cast("array<string>")).otherwise(bases)


def merge_plan(counts: DataFrame, stop_words: list[str]) -> DataFrame:
    """word, n -> word, form: the form that each word is counted as.

    A form goes to a base that two forms or more share, or that is a stop word, or, if the form ends in s, that the vocabulary
    attests: one word in -ed or -ing beside a shorter one (evening, even) is no evidence yet. Of several bases it goes to the one with
    the most uses. A base's shown form is its most frequent form (the shorter one, then the lesser, on a tie).
    Possessives always fold onto their owner.
    """
    stops = F.col("base").isin(stop_words)
    forms = counts.select("word", "n", F.explode(folding_bases(F.col("word"))).alias("base"), possessive_base(F.col("word")).alias("owner"))
    attested = counts.select(F.col("word").alias("base"), F.col("n").alias("n_base"))
    seen = forms.join(attested, "base", "left")
    every = F.count("*").over(Window.partitionBy("base"))
    worth = seen.withColumn("n_forms", every).withColumn("total", F.sum("n").over(Window.partitionBy("base")) + F.coalesce("n_base", F.lit(0)))
    good = worth.where((F.col("n_base").isNotNull() & F.col("word").endswith("s")) | stops | (F.col("n_forms") >= 2) | (F.col("owner") == F.col("base")))
    best = Window.partitionBy("word").orderBy((F.col("owner") == F.col("base")).desc_nulls_last(), F.desc("total"), "base")
    chosen = good.withColumn("place", F.row_number().over(best)).where("place = 1").select("word", "base", "n", (F.col("owner") == F.col("base")).alias("owned"))
    members = chosen.select("word", "base", "n").unionAll(
        chosen.select("base").distinct().join(attested, "base").select(F.col("base").alias("word"), "base", F.col("n_base").alias("n"))
    )
    shown = members.groupBy("base").agg(F.min(F.struct((-F.col("n")).alias("a"), F.length("word").alias("b"), "word")).alias("top")).select("base", F.col("top.word").alias("shown"))
    plan = chosen.join(shown, "base").select("word", F.when(F.coalesce("owned", F.lit(False)) | F.col("base").isin(stop_words), F.col("base")).otherwise(F.col("shown")).alias("form"))
    return plan.where("word != form")
