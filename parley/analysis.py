"""The whole analysis as one query: messages and options in, a set of tables out.

`analyze` chooses the messages (roles, speakers, card, model, text or reasoning), takes out lines and sentences that repeat, splits
what is left into words, counts them, folds English forms, leaves out what is blocked or a template, gives each word its kinds,
and shows the most frequent words. Every table of the result is a lazy DataFrame; the words of each message are written once to the
shared checkpoint folder, as all of them start there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import cleaning as C
from parley.operators import english as E
from parley.operators import kinds as K
from parley.session import cut

#: Template words: the least share of messages and of uses, uses for each message, share at the edges of messages.
TEMPLATE_MESSAGES, TEMPLATE_USES, TEMPLATE_EACH, TEMPLATE_EDGE, TEMPLATE_LEAST = 0.6, 0.5, 1.15, 0.8, 8


@dataclass(frozen=True)
class Generic:
    """Tuning of the test for words that belong to the language and not to the story."""

    dispersion: float = 0.45
    per_message: float = 1.5
    messages: int = 8
    uses: int = 4
    scan: int = 150


@dataclass(frozen=True)
class Options:
    """What to analyse and what to show. The defaults are those of the plain query."""

    roles: tuple[str, ...] = ("user", "char")
    speakers: tuple[str, ...] = ()  # none: all
    card: str | None = None
    source: str = "text"  # or "reasoning"
    model: str | None = None  # of reasoning
    min_length: int = 2
    min_count: int = 2
    most_words: int | None = 120  # none: all
    stop_words: tuple[str, ...] = ()  # beside the usual ones
    names_as_words: bool = True  # speakers' names stay whole and are no templates
    dictionary: tuple[str, ...] = ()
    english_forms: bool = True
    kinds: tuple[str, ...] | None = None  # shown; none: all
    flagged: str = "show"  # flagged words: show, hide or only
    flags: tuple[str, ...] = ()  # the flags that count; none: all
    baseline: tuple[str, ...] = ()  # words that are always blocked
    use_blocklist: bool = True
    generic: Generic = field(default_factory=Generic)
    clean: C.CleanOptions = field(default_factory=C.CleanOptions)


@dataclass(frozen=True)
class Analysis:
    """words: word, n, kind, kinds, flag, the shown ones; all_words: the same before what is hidden; tokens: one row of totals;
    sources, speakers, cards: messages and characters of each; blocked: word, reason; by_kind: kind, words; by_flag: flag,
    words; reasoning: messages with a trace for each model."""

    words: DataFrame
    all_words: DataFrame
    tokens: DataFrame
    sources: DataFrame
    speakers: DataFrame
    cards: DataFrame
    blocked: DataFrame
    by_kind: DataFrame
    by_flag: DataFrame
    reasoning: DataFrame
    bags: DataFrame


def chosen(messages: DataFrame, options: Options) -> DataFrame:
    """The messages that the options ask for."""
    rows = messages.where(F.col("role").isin(*options.roles))
    if options.speakers:
        rows = rows.where(F.col("name").isin(*options.speakers))
    return rows.where(F.coalesce("card", "source") == options.card) if options.card is not None else rows


def texts_of(messages: DataFrame, options: Options) -> DataFrame:
    """id, text of what is counted: texts without repeated lines, or reasoning traces without templates."""
    rows = chosen(messages, options)
    name = F.concat_ws("\u0001", "source", "index").alias("id")
    if options.source == "reasoning":
        traces = rows.where("reasoning is not null and reasoning != ''")
        traces = traces.where(F.col("model") == options.model) if options.model is not None else traces
        return C.clean_reasoning(traces.select(name, F.col("reasoning").alias("text")), options.clean)
    return C.strip_repeated(rows.select(name, "text"))


def acceptable(word: Column, options: Options) -> Column:
    stop = [*options.stop_words, *(C.SCHEMA_WORDS if options.source == "reasoning" else ())]
    good = T.acceptable(word, options.min_length)
    return good & ~word.isin(stop) if stop else good


def bags_of(texts: DataFrame, options: Options) -> DataFrame:
    """id, word, n, first (its first place among the words that count), size (how many count), of each text."""
    words = texts.select("id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "raw")).select("id", "pos", T.normalized(F.col("raw")).alias("word"))
    good = words.where(acceptable(F.col("word"), options)).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1)
    counted = good.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return counted.withColumn("size", F.sum("n").over(Window.partitionBy("id")))


def folded(bags: DataFrame, plan: DataFrame, options: Options) -> DataFrame:
    """The bags with the forms of plan (word, form) in place of words, so that whatever is told of words holds for all their forms."""
    forms = bags.join(plan, "word", "left").select("id", F.coalesce("form", "word").alias("word"), "n", "first").where(acceptable(F.col("word"), options))
    counted = forms.groupBy("id", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counted.withColumn("size", F.sum("n").over(Window.partitionBy("id")))


def templates(bags: DataFrame, n_texts: DataFrame) -> DataFrame:
    """word: in most texts, about once each, at an end."""
    at = F.col("first") / F.greatest(F.lit(1), F.col("size"))
    seen = bags.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("held"), F.count_if((at <= 0.2) | (at >= 0.8)).alias("edge"))
    one = seen.crossJoin(F.broadcast(n_texts)).where(
        (F.col("n_texts") >= TEMPLATE_LEAST) & (F.col("uses") >= F.col("n_texts") * TEMPLATE_USES) & (F.col("held") >= F.col("n_texts") * TEMPLATE_MESSAGES)
        & (F.col("uses") <= F.col("held") * TEMPLATE_EACH) & (F.col("edge") >= F.col("held") * TEMPLATE_EDGE)
    )
    return one.select("word")


def generic_words(bags: DataFrame, words: DataFrame, n_texts: DataFrame, tuning: Generic) -> DataFrame:
    """word: of the most frequent words (word, n) those that are spread as the texts themselves are."""
    total = bags.agg(F.sum("n").alias("every"))
    top = words.orderBy(F.desc("n"), "word").limit(tuning.scan).select("word")
    share = F.col("size") / F.col("every")
    held = bags.join(F.broadcast(top), "word").crossJoin(F.broadcast(total))
    uses = held.groupBy("word").agg(F.sum("n").alias("uses"), F.count("*").alias("held"))
    off = held.join(F.broadcast(uses), "word").groupBy("word", "uses", "held").agg(((F.sum(F.abs(F.col("n") / F.col("uses") - share) - share) + 1) / 2).alias("dispersion"))
    good = (F.col("n_texts") >= tuning.messages) & (F.col("uses") >= tuning.uses) & (F.col("dispersion") < tuning.dispersion) & (F.col("uses") <= F.col("held") * tuning.per_message)
    return off.crossJoin(F.broadcast(n_texts)).where(good).select("word")


def described(messages: DataFrame) -> DataFrame:
    """card and what is known of it: chats, messages, first and last date, models, services, regenerated replies, mean seconds."""
    by_char = F.col("role") == "char"
    return messages.groupBy(F.coalesce("card", "source").alias("card")).agg(
        F.count_distinct("source").alias("chats"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(by_char).alias("char_messages"),
        F.min("date").alias("started"), F.max("date").alias("ended"), F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("api")).alias("services"),
        F.round(F.count_if(by_char & (F.col("swipe_count") > 1)) / F.greatest(F.lit(1), F.count_if(by_char)), 6).alias("swipe_rate"), F.round(F.avg("gen_seconds"), 6).alias("mean_seconds"),
        F.sum(F.length("raw")).alias("raw_chars"), F.sum(F.length("text")).alias("clean_chars"),
    )


def analyze(messages: DataFrame, options: Options = Options(), flagged: DataFrame | None = None, listed: DataFrame | None = None) -> Analysis:
    """messages: as `chats.messages` gives them. flagged: word, flag; listed: word, reason, the blocked words."""
    spark = messages.sparkSession
    texts = texts_of(messages, options)
    bags = cut(bags_of(texts, options))
    n_texts = texts.agg(F.count("*").alias("n_texts"))
    if options.english_forms:
        bags = cut(folded(bags, E.merge_plan(bags.groupBy("word").agg(F.sum("n").alias("n")), list(T.STOP_WORDS)), options))
    counted = cut(bags.groupBy("word").agg(F.sum("n").alias("n")))

    names = [*options.dictionary]
    named = messages.select(F.lower("name").alias("word")).distinct() if options.names_as_words and "name" in messages.columns else None
    repeated = templates(bags, n_texts)
    if named is not None:
        repeated = repeated.join(named, "word", "left_anti")
    repeated = repeated.where(~F.col("word").isin(names)) if names else repeated
    reasons = repeated.select("word", F.lit("template").alias("reason"))
    if listed is not None and options.use_blocklist:
        reasons = listed.select("word", "reason").unionAll(reasons)
    reasons = reasons.groupBy("word").agg(F.min("reason").alias("reason"))
    marked = K.block(counted, list(options.baseline), reasons)
    blocked = marked.where("reason is not null").select("word", "n", "reason")
    allowed = marked.where("reason is null").select("word", "n")

    everywhere = generic_words(bags, allowed, n_texts, options.generic).select("word", F.lit(True).alias("generic"))
    tags = K.mark_generic(F.col("tags"), F.coalesce("generic", F.lit(False)))
    typed = K.typed(allowed).join(F.broadcast(everywhere), "word", "left").select("word", "n", tags.alias("kinds"))
    flags = flagged if flagged is not None else spark.createDataFrame([], "word string, flag string")
    typed = typed.join(flags.groupBy("word").agg(F.min("flag").alias("flag")), "word", "left").select("word", "n", F.col("kinds")[0]["kind"].alias("kind"), "kinds", "flag")

    eligible = typed.where(F.col("n") >= options.min_count)
    if options.kinds is not None:
        eligible = eligible.where(K.visible(F.col("kinds"), list(options.kinds)))
    counts = F.col("flag").isNotNull() & (F.col("flag").isin(*options.flags) if options.flags else F.lit(True))
    shown = {"show": F.lit(True), "hide": ~counts, "only": counts}[options.flagged]
    words = eligible.where(shown).orderBy(F.desc("n"), "word")
    words = words if options.most_words is None else words.limit(options.most_words)
    kept = chosen(messages, options)
    tokens = texts.select(T.raw_tokens(F.col("text")).alias("raw")).where(F.col("raw").rlike(r"[\p{L}\p{N}]")).agg(F.count("*").alias("tokens"))
    totals = tokens.crossJoin(bags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"), F.count_distinct("word").alias("different")))
    return Analysis(
        words=words, all_words=typed, tokens=totals, bags=bags, blocked=blocked,
        sources=messages.groupBy("source").agg(F.count("*").alias("messages"), F.sum(F.length("raw")).alias("raw_chars"), F.sum(F.length("text")).alias("clean_chars")),
        speakers=messages.groupBy("name").agg(F.min_by("role", F.struct("source", "index")).alias("role"), F.count("*").alias("messages")),
        cards=described(messages),
        by_kind=typed.where(F.col("n") >= options.min_count).select(F.explode(F.array_distinct("kinds.kind")).alias("kind")).groupBy("kind").agg(F.count("*").alias("words")),
        by_flag=eligible.where("flag is not null").groupBy("flag").agg(F.count("*").alias("words")),
        reasoning=kept.where("reasoning is not null").groupBy("model").agg(F.count("*").alias("messages")),
    )
