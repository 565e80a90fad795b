"""The whole analysis over the conversations."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import analysis as A
from parley.operators import cleaning as C
from parley.plans.english import sql_folded
from parley.plans.kinds import sql_typed
from parley.plans.words import SQL_ACCEPT, SQL_STOP, sql_tokens
from parley.session import table

CARD, SPEAKER = "card 3", "voice 2"
FLAGGED = (("clown", "mild"), ("of", "mild"), ("queue", "strong"), ("window", "strong"))
LISTED = (("river", "manual"), ("stone", "auto"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as messages: ten cards, three speakers, and a reasoning trace where the turn is odd."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[*_~`]+", " "), "[ \t]+", " "))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("card "), (F.col("conv_id") % 10).cast("string")).alias("card"), F.col("turn").cast("int").alias("index"),
        F.concat(F.lit("voice "), (F.col("conv_id") % 3).cast("string")).alias("name"), F.when(F.col("role") == "assistant", "char").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("raw"), text.alias("text"), F.lit(None).cast("string").alias("date"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("I must keep to the rules of this house. "), "text")).alias("reasoning"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("model "), (F.col("conv_id") % 2).cast("string"))).alias("model"), F.lit(None).cast("string").alias("api"),
        F.col("turn").cast("double").alias("gen_seconds"), (F.col("turn") % 3 + 1).cast("int").alias("swipe_count"),
    )


def analyze_default(spark, sf_dir):
    return A.analyze(messages(spark, sf_dir)).words.select("word", "n", "kind")


def analyze_scoped(spark, sf_dir):
    """One speaker's words of one card, flagged words hidden, some words blocked, forms as they stand."""
    options = A.Options(speakers=(SPEAKER,), card=CARD, flagged="hide", flags=("mild",), english_forms=False, min_count=1, baseline=("is", "thin"), most_words=None)
    flagged, listed = (spark.createDataFrame(rows, f"word string, {name} string") for rows, name in ((FLAGGED, "flag"), (LISTED, "reason")))
    return A.analyze(messages(spark, sf_dir), options, flagged, listed).words.select("word", "n", "flag")


def reasoning_words(spark, sf_dir):
    """Words of the traces of one model, without the sentence that all of them repeat."""
    options = A.Options(source="reasoning", model="model 1", english_forms=False, min_count=1, most_words=None)
    return A.analyze(messages(spark, sf_dir), options).words.select("word", "n")


def card_descriptions(spark, sf_dir):
    return A.described(messages(spark, sf_dir)).drop("models", "services", "started", "ended")


def reasoning_models(spark, sf_dir):
    return A.analyze(messages(spark, sf_dir)).reasoning


@lru_cache(maxsize=1)
def _texts() -> str:
    return r"""msgs as (select cast(conv_id as varchar) as source, turn as index, 'card ' || (conv_id % 10) as card, 'voice ' || (conv_id % 3) as name, case when role = 'assistant' then 'char' else role end as role,
        text as raw, trim(regexp_replace(regexp_replace(text, '[*_~`]+', ' ', 'g'), '[ \t]+', ' ', 'g')) as text, turn % 2 as odd, conv_id, turn from conversations)"""


def _kept(where: str) -> str:
    return f"""kept as (select source || '|' || index as id, text from msgs where role in ('user', 'char') and {where}),
    lines as (select distinct id, trim(unnest(string_split(text, chr(10)))) as line from kept), bad as (select coalesce(list(line), []) as bad from (select line from lines where length(line) >= 6
        group by line having count(*) >= greatest(5, ceil((select count(*) from kept) * 0.25)) and (select count(*) from kept) >= 5)),
    texts as (select id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(bad, trim(x))), chr(10)) as text from kept cross join bad)"""


def _template(bags: str, name: str, source: str) -> str:
    return f"""{name} as (select word from (select word, sum(n) as uses, count(*) as held, count(*) filter (first / greatest(1, size) <= 0.2 or first / greatest(1, size) >= 0.8) as edge from {bags} group by 1) cross join n_texts
        where c >= 8 and uses >= c * 0.5 and held >= c * 0.6 and uses <= held * 1.15 and edge >= held * 0.8)"""


def _words(source: str = "texts") -> str:
    return f"""t as ({sql_tokens(source, "id")}), place as (select *, row_number() over (partition by id order by pos) - 1 as place from t where {SQL_ACCEPT}),
    bag as (select id, word, count(*) as n, min(place) as first from place group by all), mw as (select *, sum(n) over (partition by id) as size from bag), v as (select word, cast(sum(n) as bigint) as n from bag group by 1),
    n_texts as (select count(*) as c from {source}), {_template("mw", "template", source)}"""


QUERIES = {
    "analyze_default": analyze_default, "analyze_scoped": analyze_scoped, "reasoning_words": reasoning_words, "card_descriptions": card_descriptions, "reasoning_models": reasoning_models,
}
_FLAGS = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in FLAGGED) + ") f(word, flag)"
_LISTED = ", ".join(f"'{a}'" for a, _ in LISTED)
ORACLES = {
    "analyze_default": f"""with {_texts()}, {_kept("true")}, {_words()}, {sql_folded("v")},
        fbag as (select id, coalesce(form, word) as word, sum(n) as n, min(first) as first from bag left join plan using (word) where coalesce(form, word) not in ({SQL_STOP}) group by all), fmw as (select *, sum(n) over (partition by id) as size from fbag),
        {_template("fmw", "ftemplate", "texts")}, w as (select * from folded where word not in (select word from ftemplate) and word not in ({SQL_STOP})), tot as (select sum(n) as every from fbag),
        top as (select word from w order by n desc, word limit 150), held as (select fmw.*, every from fmw join top using (word) cross join tot),
        uses as (select word, sum(n) as uses, count(*) as held from held group by 1),
        off as (select word, uses, held, (sum(abs(n / uses - size / every) - size / every) + 1) / 2 as d from held join uses using (word) group by all),
        gen as (select word from off cross join n_texts where c >= 8 and uses >= 4 and d < 0.45 and uses <= held * 1.5),
        typed as (select word, n, {sql_typed("word")} as found from w), named as (select word, n, case when len(found) > 0 then found[1] when word in (select word from gen) then 'generic' else 'plain' end as kind from typed)
        select word, n, kind from named where n >= 2 order by n desc, word limit 120""",
    "analyze_scoped": f"""with {_texts()}, {_kept(f"name = '{SPEAKER}' and card = '{CARD}'")}, {_words()}
        select word, n, flag from v left join {_FLAGS} using (word) where word not in (select word from template) and word not in ({_LISTED}) and word not in ('is', 'thin') and not contains(word, 'thin') and coalesce(flag, '') != 'mild'""",
    "reasoning_words": f"""with {_texts()}, texts as (select source || '|' || index as id, text from msgs where role in ('user', 'char') and odd = 1 and conv_id % 2 = 1 and text != ''), {_words()}
        select word, n from v where word not in (select word from template) and word not in ({", ".join(f"'{w}'" for w in C.SCHEMA_WORDS)})""",
    "card_descriptions": f"""with {_texts()} select card, count(distinct source) as chats, count(*) as messages, count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'char') as char_messages,
        round(count(*) filter (role = 'char' and turn % 3 > 0) / greatest(1, count(*) filter (role = 'char')), 6) as swipe_rate, round(avg(cast(turn as double)), 6) as mean_seconds,
        cast(sum(length(raw)) as bigint) as raw_chars, cast(sum(length(text)) as bigint) as clean_chars from msgs group by 1""",
    "reasoning_models": f"with {_texts()} select 'model ' || (conv_id % 2) as model, count(*) as messages from msgs where role in ('user', 'char') and odd = 1 group by 1",
}
