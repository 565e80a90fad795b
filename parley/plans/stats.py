"""Totals, dispersion and co-occurrence over conversations.

A conversation is a source (a card), a turn a message. All word statistics start from one row for each message and word,
which partial aggregation makes before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.plans.words import SQL_ACCEPT, sql_tokens, token_rows
from parley.session import table

#: Tuning of the generic-word test: dispersion, uses for each message, least messages and uses.
GENERIC_DP, GENERIC_PER_MESSAGE, GENERIC_MESSAGES, GENERIC_COUNT, GENERIC_SCAN = 0.45, 1.5, 8, 4, 150
#: Pairs: words considered, least shared messages, pairs kept.
COOCCUR_TOP, COOCCUR_LEAST, COOCCUR_MOST = 120, 2, 50_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story's messages: those of users and assistants."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))


def message_words(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    """conv_id, turn, word, n, first (its first place), size (tokens of the message that count)."""
    words = token_rows(messages(spark, sf_dir).withColumn("text", F.expr(text)), "conv_id", "turn").where(T.acceptable(F.col("word")))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")) - 1
    bag = words.withColumn("place", place)
    counted = bag.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return counted.withColumn("size", F.sum("n").over(Window.partitionBy("conv_id", "turn")))


def sql_bags(source: str = "conversations") -> str:
    return f"""toks as ({sql_tokens(source, "conv_id, turn", "role in ('user', 'assistant')")}),
    bag as (select *, row_number() over (partition by conv_id, turn order by pos) - 1 as place from toks where {SQL_ACCEPT}),
    counted as (select conv_id, turn, word, count(*) as n, min(place) as first from bag group by all),
    mw as (select *, cast(sum(n) over (partition by conv_id, turn) as bigint) as size from counted)"""


SQL_BAGS = sql_bags()
# Words that the language would put into most messages, as the table has none: one in each, one in every second, and one in bursts.
FILLED = "concat('withal ', text, case when (conv_id + turn) % 2 = 0 then ' anon' else '' end, case when conv_id % 9 = 0 then ' clan clan clan' else '' end)"
SQL_MESSAGES = "(select count(*) from conversations where role in ('user', 'assistant'))"


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = token_rows(messages(spark, sf_dir), "conv_id", "turn")
    good = T.acceptable(F.col("word"))
    return words.agg(
        F.count("*").alias("total_tokens"), F.count_if(good).alias("counted_tokens"), F.count_distinct(F.when(good, F.col("word"))).alias("unique_words")
    )


def word_counts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counted(table(spark, sf_dir, "documents"), "source").where("n >= 20")


def speaker_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers are named by role and the parity of their conversation, as the table has no names."""
    rows = table(spark, sf_dir, "conversations").withColumn("speaker", F.concat("role", F.lit("-"), (F.col("conv_id") % 7).cast("string")))
    return rows.groupBy("speaker").agg(F.min_by("role", F.struct("conv_id", "turn")).alias("role"), F.count("*").alias("n_messages"))


def per_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.sum(F.length("text")).alias("raw_chars"),
        F.sum(F.length(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("clean_chars"),
    )


def role_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("role").isin("user", "assistant")
    return table(spark, sf_dir, "conversations").agg(
        F.count_if(kept).alias("message_count"),
        F.count("*").alias("total_messages"),
        F.sum(F.when(kept, F.length("text")).otherwise(0)).alias("raw_chars"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("char_messages"),
    )


def card_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-card totals and the grand total in one job; the grand total has a null card."""
    rows = table(spark, sf_dir, "conversations").withColumn("card", F.col("conv_id") % 10)
    return rows.rollup("card").agg(F.count("*").alias("n_messages"), F.count_distinct("conv_id").alias("n_chats"), F.max("turn").alias("last_turn"))


def generic_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are spread as the text itself is: half the summed difference between a word's share of each message and
    the message's share of all tokens, in closed form over the messages that hold the word."""
    bags = message_words(spark, sf_dir, FILLED)
    total = bags.agg(F.sum("n").alias("all_tokens"))
    counts = messages(spark, sf_dir).agg(F.count("*").alias("n_messages"))
    words = bags.groupBy("word").agg(F.sum("n").alias("total"))
    top = words.orderBy(F.desc("total"), "word").limit(GENERIC_SCAN)
    share = F.col("size") / F.col("all_tokens")
    held = bags.join(F.broadcast(top), "word").crossJoin(total).withColumn("off", F.abs(F.col("n") / F.col("total") - share) - share)
    found = held.groupBy("word", "total").agg(F.count("*").alias("in_messages"), F.round((F.sum("off") + 1) / 2, 6).alias("dp")).crossJoin(counts)
    return found.where(
        (F.col("n_messages") >= GENERIC_MESSAGES) & (F.col("total") >= GENERIC_COUNT) & (F.col("dp") < GENERIC_DP) & (F.col("total") <= F.col("in_messages") * GENERIC_PER_MESSAGE)
    ).select("word", "total", "in_messages", "dp")


def template_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand in most messages, about once each, at the start or the end. Shares are of the messages of a role,
    so that the templates of one speaker are found."""
    bags = message_words(spark, sf_dir)
    n_messages = messages(spark, sf_dir).agg(F.count("*").alias("n_messages"))
    at = F.col("first") / F.greatest(F.lit(1), F.col("size"))
    words = bags.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("in_messages"), F.count_if((at <= 0.2) | (at >= 0.8)).alias("at_edge"))
    flagged = (
        (F.col("n_messages") >= 8) & (F.col("total") >= F.col("n_messages") * 0.5) & (F.col("in_messages") >= F.col("n_messages") * 0.6)
        & (F.col("total") <= F.col("in_messages") * 1.15) & (F.col("at_edge") >= F.col("in_messages") * 0.8)
    )
    return words.crossJoin(n_messages).where("total >= n_messages * 0.02").select("word", "total", "in_messages", "at_edge", flagged.alias("is_template"))


def top_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages hold which of the most frequent words."""
    bags = message_words(spark, sf_dir)
    top = bags.groupBy("word").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "word").limit(COOCCUR_TOP).select("word")
    return bags.join(F.broadcast(top), "word").select("conv_id", "turn", "word")


def cooccur_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frequent words by shared messages. A message holds at most COOCCUR_TOP of them, so its pairs are bounded."""
    held = top_presence(spark, sf_dir)
    words = F.array_sort(F.collect_set("word"))
    bags = held.groupBy("conv_id", "turn").agg(words.alias("words"))
    first = bags.select("words", F.posexplode("words").alias("k", "a"))
    pairs = first.select("a", F.explode(F.slice("words", F.col("k") + 2, F.size("words"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COOCCUR_LEAST).orderBy(F.desc("n"), "a", "b").limit(COOCCUR_MOST)


def cooccur_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared messages over those of the rarer word."""
    docs = top_presence(spark, sf_dir).groupBy("word").agg(F.count("*").alias("docs"))
    pairs = cooccur_pairs(spark, sf_dir)
    joined = pairs.join(F.broadcast(docs.select(F.col("word").alias("a"), F.col("docs").alias("docs_a"))), "a")
    joined = joined.join(F.broadcast(docs.select(F.col("word").alias("b"), F.col("docs").alias("docs_b"))), "b")
    return joined.select("a", "b", F.round(F.least(F.lit(1.0), F.col("n") / F.least("docs_a", "docs_b")), 6).alias("rate"))


def neighbor_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of two words' vectors of shared messages, each left out of the other's vector."""
    pairs = cooccur_pairs(spark, sf_dir)
    both = pairs.select("a", "b", "n").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    square = both.groupBy("a").agg(F.sum(F.col("n") * F.col("n")).alias("square"))
    x = both.select(F.col("a").alias("x"), F.col("b").alias("k"), F.col("n").alias("nx"))
    y = both.select(F.col("a").alias("y"), F.col("b").alias("k"), F.col("n").alias("ny"))
    dots = x.join(y, "k").where("x < y").groupBy("x", "y").agg(F.sum(F.col("nx") * F.col("ny")).alias("dot"))
    linked = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n")
    sx, sy = square.select(F.col("a").alias("x"), F.col("square").alias("sx")), square.select(F.col("a").alias("y"), F.col("square").alias("sy"))
    joined = dots.join(linked, ["x", "y"], "left").join(F.broadcast(sx), "x").join(F.broadcast(sy), "y")
    own = F.coalesce(F.col("n"), F.lit(0)) * F.coalesce(F.col("n"), F.lit(0))
    length = F.sqrt((F.col("sx") - own).cast("double")) * F.sqrt((F.col("sy") - own).cast("double"))
    return joined.where((F.col("sx") > own) & (F.col("sy") > own)).select("x", "y", F.round(F.col("dot") / length, 6).alias("similarity"))


_SQL_PRESENCE = f"""{SQL_BAGS},
    top as (select word from (select word, sum(n) as total from mw group by word) order by total desc, word limit {COOCCUR_TOP}),
    held as (select conv_id, turn, word from mw semi join top using (word)),
    pairs as (select x.word as a, y.word as b, count(*) as n from held x join held y using (conv_id, turn) where x.word < y.word
        group by all having count(*) >= {COOCCUR_LEAST} order by n desc, a, b limit {COOCCUR_MOST})"""

QUERIES = {
    "token_totals": token_totals, "word_counts_docs": word_counts_docs, "speaker_tally": speaker_tally, "per_source_totals": per_source_totals, "role_totals": role_totals,
    "card_rollup": card_rollup, "generic_dp": generic_dp, "template_words": template_words, "cooccur_pairs": cooccur_pairs, "cooccur_rate": cooccur_rate, "neighbor_cosine": neighbor_cosine,
}
ORACLES = {
    "token_totals": f"""with t as ({sql_tokens("conversations", "conv_id, turn", "role in ('user', 'assistant')")})
        select count(*) as total_tokens, count(*) filter ({SQL_ACCEPT}) as counted_tokens, count(distinct case when {SQL_ACCEPT} then word end) as unique_words from t""",
    "word_counts_docs": f"""with t as ({sql_tokens("documents", "source")}) select source, word, count(*) as n from t where {SQL_ACCEPT} group by all having count(*) >= 20""",
    "speaker_tally": """select role || '-' || (conv_id % 7) as speaker, arg_min(role, (conv_id, turn)) as role, count(*) as n_messages from conversations group by 1""",
    "per_source_totals": r"""select conv_id, count(*) as n_messages, cast(sum(length(text)) as bigint) as raw_chars,
        cast(sum(length(trim(regexp_replace(text, '\s+', ' ', 'g')))) as bigint) as clean_chars from conversations group by 1""",
    "role_totals": """select count(*) filter (role in ('user', 'assistant')) as message_count, count(*) as total_messages,
        cast(sum(case when role in ('user', 'assistant') then length(text) else 0 end) as bigint) as raw_chars,
        count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'assistant') as char_messages from conversations""",
    "card_rollup": """select conv_id % 10 as card, count(*) as n_messages, count(distinct conv_id) as n_chats, max(turn) as last_turn from conversations group by rollup (conv_id % 10)""",
    "generic_dp": f"""with {sql_bags(f"(select conv_id, turn, role, {FILLED} as text from conversations)")}, tot as (select cast(sum(n) as bigint) as all_tokens from mw), words as (select word, cast(sum(n) as bigint) as total from mw group by word),
        top as (select * from words order by total desc, word limit {GENERIC_SCAN}),
        held as (select *, abs(n / total - size / all_tokens) - size / all_tokens as off from mw join top using (word) cross join tot),
        found as (select word, total, count(*) as in_messages, round((sum(off) + 1) / 2, 6) as dp from held group by word, total)
        select * from found where {SQL_MESSAGES} >= {GENERIC_MESSAGES} and total >= {GENERIC_COUNT} and dp < {GENERIC_DP} and total <= in_messages * {GENERIC_PER_MESSAGE}""",
    "template_words": f"""with {SQL_BAGS}, words as (select word, cast(sum(n) as bigint) as total, count(*) as in_messages,
            count(*) filter (first / greatest(1, size) <= 0.2 or first / greatest(1, size) >= 0.8) as at_edge from mw group by word), m as (select {SQL_MESSAGES} as n)
        select word, total, in_messages, at_edge, m.n >= 8 and total >= m.n * 0.5 and in_messages >= m.n * 0.6 and total <= in_messages * 1.15 and at_edge >= in_messages * 0.8 as is_template
        from words cross join m where total >= m.n * 0.02""",
    "cooccur_pairs": f"with {_SQL_PRESENCE} select a, b, n from pairs",
    "cooccur_rate": f"""with {_SQL_PRESENCE}, docs as (select word, count(*) as docs from held group by word)
        select a, b, round(least(1.0, n / least(p.docs, q.docs)), 6) as rate from pairs join docs p on p.word = a join docs q on q.word = b""",
    "neighbor_cosine": f"""with {_SQL_PRESENCE}, both_ways as (select a, b, n from pairs union all select b, a, n from pairs), square as (select a, sum(n * n) as sq from both_ways group by a),
        dots as (select x.a as x, y.a as y, sum(x.n * y.n) as dot from both_ways x join both_ways y on x.b = y.b where x.a < y.a group by all),
        own as (select dots.*, coalesce(pairs.n, 0) * coalesce(pairs.n, 0) as own, p.sq as sx, q.sq as sy from dots left join pairs on pairs.a = x and pairs.b = y join square p on p.a = x join square q on q.a = y)
        select x, y, round(dot / (sqrt(cast(sx - own as double)) * sqrt(cast(sy - own as double))), 6) as similarity from own where sx > own and sy > own""",
}
