"""What is done with a finished word table: flags, review filters, contributions, audits, and aliases by coreference."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The flag of a short word of which only one character is listed.
MAYBE = "maybe"
#: Words of a contribution, the least uses of one, and how many changed kinds go along.
MOST_SHARED, LEAST_USES, MOST_FIXES = 100, 2, 50
# What stands at the end of a name to tell versions of a card apart.
VERSION = r"(?i)\s*[-_ ]?\(?v?\d+(?:\.\d+)*\)?$"


def flag_words(words: DataFrame, listed: DataFrame) -> DataFrame:
    """word, ... and `flag`: of the listed entries (entry, flag, place) the first that is the word, stands in it (entries of three
    characters or more), or of which a word of two holds a character (flag MAYBE). The list is small, and met by its parts:
    a word is cut into its pieces of the lengths that entries have, so no pair of a word and an entry is made in vain."""
    entries = listed.select(F.lower("entry").alias("entry"), "flag", "place").where("entry != ''")
    lengths = [r[0] for r in entries.where(F.length("entry") >= 3).select(F.length("entry").alias("n")).distinct().orderBy("n").collect()]
    word = F.lower("word")

    def pieces(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda k: F.substring(word, k, F.lit(n)))
        return F.when(F.length(word) > n, every).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.concat(F.array(word), *map(pieces, lengths)))
    met = words.select("word", F.explode(parts).alias("entry")).join(entries, "entry")
    single = entries.where(F.length("entry") == 1)
    short = words.where(F.length("word") == 2).select("word", F.explode(F.split(word, "")).alias("entry")).join(single, "entry").select("word", F.lit(MAYBE).alias("flag"), (F.col("place") + F.lit(1 << 20)).alias("place"))
    first = met.select("word", "flag", "place").unionByName(short).groupBy("word").agg(F.min_by("flag", "place").alias("flag"))
    return words.join(first, "word", "left")


def flag_counts(words: DataFrame, flags: list[str]) -> DataFrame:
    """flag, words: how many of the words (word, flag) have each flag, those without any included."""
    every = words.sparkSession.createDataFrame([(f,) for f in flags], "flag string")
    return every.join(words.groupBy("flag").agg(F.count("*").alias("words")), "flag", "left").select("flag", F.coalesce("words", F.lit(0)).alias("words"))


def review(words: DataFrame, kind: str | None = None, needle: str = "", fold: tuple[str, str] = ("", "")) -> DataFrame:
    """The words (word, n, kinds) of a tab that hold the needle, case aside. fold: characters and what they are shown as, so that
    the shown form is sought as well."""
    rows = words.where(F.array_contains("kinds", kind)) if kind else words
    low = F.lower("word")
    return rows.where(low.contains(needle.lower()) | F.translate(low, *fold).contains(needle.lower())) if needle else rows


def contribution(words: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """The most frequent words (word, n, kind, flag, priority) that may be shared: no persons, generic, flagged or chosen ones."""
    free = ~F.col("kind").isin("person", "generic") & F.col("flag").isNull() & ~F.col("priority") & (F.col("n") >= LEAST_USES)
    return words.where(free).orderBy(F.desc("n"), "word").limit(most).select("word", "n", "kind")


def han_share(words: DataFrame) -> DataFrame:
    """One row: the share of uses (word, n) of words with Han characters."""
    return words.agg(F.round(F.sum(F.when(F.col("word").rlike(r"\p{IsHan}"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


def payload(words: DataFrame, changed: DataFrame, most: int = MOST_SHARED, fixes: int = MOST_FIXES) -> DataFrame:
    """One row, what a contribution sends: words (word, n, kind), share (of uses in Han), kinds (how many words of each), fixes (word,
    kind): the user's changes (word, kind) of kinds, most frequent words first."""
    sent = contribution(words, most)
    place = lambda c: F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), *c)))
    listed = sent.agg(F.transform(place(["word", "kind"]), lambda x: F.struct(x["word"].alias("word"), (-x["a"]).alias("n"), x["kind"].alias("kind"))).alias("words"))
    kinds = sent.groupBy("kind").agg(F.count("*").alias("words")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "words")))).alias("kinds"))
    moved = words.join(changed.select("word", F.col("kind").alias("new")), "word").where("new != kind").orderBy(F.desc("n"), "word").limit(fixes)
    fixed = moved.agg(F.transform(place(["word", "new"]), lambda x: F.struct(x["word"].alias("word"), x["new"].alias("kind"))).alias("fixes"))
    return listed.crossJoin(han_share(sent)).crossJoin(kinds).crossJoin(fixed)  # four rows of one


def junk_rate(words: DataFrame, filler: DataFrame, top: int) -> DataFrame:
    """One row: the share of the `top` most frequent words (word, n) that are listed as filler (word)."""
    first = words.orderBy(F.desc("n"), "word").limit(top)
    met = first.join(filler.select("word").distinct().withColumn("junk", F.lit(1)), "word", "left")
    return met.agg(F.count("*").alias("words"), F.round(F.sum(F.coalesce("junk", F.lit(0))) / F.count("*"), 6).alias("rate"))


def contaminants(words: DataFrame, families: dict[str, str], top: int = 60) -> DataFrame:
    """family, word: words of the `top` most frequent that one of the patterns finds; none should."""
    first = words.orderBy(F.desc("n"), "word").limit(top)
    found = F.array_compact(F.array(*[F.when(F.col("word").rlike(p), F.lit(name)) for name, p in families.items()]))
    return first.select(F.explode(found).alias("family"), "word")


def mcnemar(only_first: int, only_second: int) -> float:
    """The two-sided probability of such a difference of two paired tests by chance: exact for few cases, else by the corrected
    chi-square."""
    n = only_first + only_second
    if n == 0:
        return 1.0
    if n < 25:
        tail = sum(math.comb(n, k) for k in range(min(only_first, only_second) + 1)) / 2**n
        return min(1.0, 2 * tail)
    return math.erfc(math.sqrt(max(0, abs(only_first - only_second) - 1) ** 2 / n / 2))


def known_groups(groups: DataFrame, words: DataFrame) -> DataFrame:
    """The proposed groups (full, alias) of which both names are in the table."""
    have = words.select("word")
    return groups.join(have.withColumnRenamed("word", "full"), "full", "left_semi").join(have.withColumnRenamed("word", "alias"), "alias", "left_semi").select("full", "alias")


def coref_aliases(groups: DataFrame, user: DataFrame, parted: DataFrame) -> DataFrame:
    """source, target: the user's aliases, and those of the groups (full, alias) that the user has neither parted (full) nor given
    another target."""
    proposed = groups.join(parted, "full", "left_anti").select(F.col("alias").alias("source"), F.col("full").alias("target"))
    return user.select("source", "target").unionAll(proposed.join(user.select("source"), "source", "left_anti").select("source", "target"))


def names_of(messages: DataFrame, chats: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """name: of speakers, users and cards, as they stand and without a version at the end."""
    every = messages.select("name").unionAll(chats.select("user_name")).unionAll(chats.select("card")).where("name is not null")
    both = every.select(F.explode(F.array(F.trim("name"), F.trim(F.regexp_replace("name", VERSION, "")))).alias("name"))
    return both.where(F.length("name").between(least, most)).distinct()


def fingerprint(name: Column, content: Column | None = None) -> Column:
    """The identity of a card: sha256 of its name in one width, case and spelling without its version, with the content's own for
    the strong form."""

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        return names.map(lambda x: unicodedata.normalize("NFKC", x).strip().lower(), na_action="ignore")

    weak = F.trim(F.regexp_replace(folded(name), VERSION, ""))
    return F.sha2(weak if content is None else F.concat(weak, F.lit("\u0001"), F.sha2(content, 256)), 256)


def contexts(texts: DataFrame, word: str, around: int, key: str = "id") -> DataFrame:
    """key, use (from 1), at (its first character, from 1), snippet: every use of a word, in upper or lower case, with what stands
    around it in one line."""
    low, wanted = F.lower("text"), F.lit(word.lower())
    uses = F.size(F.split(low, F.lit("\\Q" + word.lower() + "\\E"))) - 1
    end = lambda k: F.length(F.call_function("substring_index", low, wanted, k)) + 1
    found = texts.where(low.contains(wanted)).select(key, "text", F.posexplode(F.transform(F.sequence(F.lit(1), uses), end)).alias("k", "at"))
    start = F.greatest(F.lit(1), F.col("at") - around)
    snippet = F.regexp_replace(F.substring("text", start, F.col("at") - start + len(word) + around), r"\s+", " ")
    return found.select(key, (F.col("k") + 1).alias("use"), "at", snippet.alias("snippet"))
