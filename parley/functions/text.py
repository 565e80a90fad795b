"""Column expressions over text: tokens, letters, and the acceptance test for words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word pattern. A word is a run of letters, marks, digits and underscores; an apostrophe or a full
# stop between two such runs does not end it.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"

# The function words that are never counted.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its me my no not of on or "
    "our she so that the their them then there they this to was we were what when which who will with you your"
).split()


def tokens(text: Column) -> Column:
    """The words of a text in order, as an array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"[\p{L}\p{N}]"))


def raw_tokens(text: Column) -> Column:
    """One row for each word as `tokens` has it, or for a run of marks and underscores alone, which is no word."""
    return F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0)))


def has_han(word: Column) -> Column:
    return word.rlike(r"\p{IsHan}")


def normalized(word: Column) -> Column:
    """Lower case, except for words that hold Han characters."""
    return F.when(has_han(word), word).otherwise(F.lower(word))


def acceptable(word: Column, min_length: int = 2) -> Column:
    """Long enough, no function word, and not made of digits and number signs only."""
    return (F.length(word) >= min_length) & ~word.isin(STOP_WORDS) & ~word.rlike(r"^[0-9.,:%/-]+$")


def counted(texts: DataFrame, *keys: str, every: bool = False) -> DataFrame:
    """keys, word, n: how often each acceptable word (with `every`: each word) stands in the texts.

    Words are counted as they are spelled first, so that the tests and the folding of case see each spelling once. The tests name the
    count, as otherwise the optimizer would make them of each use, before the counting.
    """
    spelled = texts.select(*keys, raw_tokens(F.col("text")).alias("raw")).groupBy(*keys, "raw").agg(F.count("*").alias("uses"))
    once = lambda test: F.when(F.col("uses") > 0, test)
    words = spelled.where(once(F.col("raw").rlike(r"[\p{L}\p{N}]"))).select(*keys, normalized(F.col("raw")).alias("word"), "uses")
    return words.where(once(F.lit(every) | acceptable(F.col("word")))).groupBy(*keys, "word").agg(F.sum("uses").alias("n"))
