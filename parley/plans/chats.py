"""Conversations written as chat exports and read back, and counted as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.plans.words import SQL_ACCEPT, sql_tokens
from parley.session import shared_root, table
from parley.sources import chats as S
from parley.streaming.counts import IncrementalCounts


def jsonl_files(spark, sf_dir):
    """Each conversation as the lines of an export: a metadata line, then its messages; system turns are notices."""
    rows = table(spark, sf_dir, "conversations")
    extra = F.when(F.col("role") == "system", F.lit('{"type": "narrator"}')).otherwise(F.lit("[]"))
    message = F.to_json(F.struct(F.concat(F.lit("name of "), F.col("role")).alias("name"), (F.col("role") == "user").alias("is_user"), F.col("text").alias("mes"), F.array("text", F.lit("other")).alias("swipes"), F.lit(0).alias("swipe_id")))
    line = F.concat(F.left(message, F.length(message) - 1), F.lit(', "extra": '), extra, F.lit("}"))
    source = F.concat(F.lit("card "), (F.col("conv_id") % 5).cast("string"), F.lit(" - 2024-01-01@00h00m00s0ms #"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    said = rows.select(source.alias("source"), (F.col("turn") + 1).alias("line_no"), line.alias("line"))
    who = F.when(F.col("conv_id") % 2 == 0, "Me").otherwise("unused")
    head = F.concat(F.lit('{"user_name": "'), who, F.lit('", "character_name": "unused"}'))
    meta = rows.select(source.alias("source"), head.alias("line")).distinct().select("source", F.lit(0).cast("long").alias("line_no"), "line")
    return said.unionAll(meta)


def jsonl_roundtrip(spark, sf_dir):
    return S.messages(S.records(jsonl_files(spark, sf_dir))).select("source", "index", "name", "role", "raw", "swipe_count")


def chat_meta(spark, sf_dir):
    return S.chats(S.records(jsonl_files(spark, sf_dir))).select("source", "user_name", "card", "started", "broken_lines")


def txt_islands(spark, sf_dir):
    """Conversations of user and assistant as plain text, one line for each line of a message; every fifth message quotes a
    line that looks like another speaker's."""
    rows = table(spark, sf_dir, "conversations").where("role != 'system'")
    said = rows.select(F.col("conv_id").cast("string").alias("source"), "turn", F.expr(_TALK).alias("t"))
    lines = said.select("source", "turn", F.posexplode(F.split("t", "\n")).alias("k", "line")).select("source", (F.col("turn") * 100000 + F.col("k")).alias("line_no"), "line")
    return S.plain_text(lines).select("source", "index", "name", "role", "raw")


def incremental_equals_batch(spark, sf_dir):
    """Counts from a stream over the conversations, dealt into four files first, one file a batch."""
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations")
    rows.repartition(4, "conv_id").write.parquet(f"{base}/in")
    return IncrementalCounts(spark, f"{base}/counts").run(f"{base}/in", rows.schema, f"{base}/checkpoint").where("n >= 2")


_TALK = """concat(role, ': ', text, case when (conv_id + turn) % 5 = 0 then concat(chr(10), 'Voice ', cast(turn as string), ': far away', chr(10), '- note: no name', chr(10), 'http://x: y') else '' end)"""
_SOURCE = "'card ' || (conv_id % 5) || ' - 2024-01-01@00h00m00s0ms #' || conv_id || '.jsonl'"
QUERIES = {"jsonl_roundtrip": jsonl_roundtrip, "chat_meta": chat_meta, "txt_islands": txt_islands, "incremental_equals_batch": incremental_equals_batch}
ORACLES = {
    "jsonl_roundtrip": f"""select {_SOURCE} as source, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as index, 'name of ' || role as name,
        case role when 'assistant' then 'char' else role end as role, text as raw, 2 as swipe_count from conversations""",
    "chat_meta": f"select {_SOURCE} as source, case when conv_id % 2 = 0 then 'Me' when count(*) filter (role = 'user') > 0 then 'name of user' end as user_name, 'card ' || (conv_id % 5) as card, '2024-01-01T00:00:00' as started, 0::bigint as broken_lines from conversations group by conv_id",
    "txt_islands": f"""with t as (select cast(conv_id as varchar) as source, turn, string_split({_TALK}, chr(10)) as ls from conversations where role != 'system'),
        l as (select source, turn * 100000 + generate_subscripts(ls, 1) as k, unnest(ls) as line from t),
        c as (select *, least(nullif(instr(line, ':'), 0), nullif(instr(line, '：'), 0)) as pos from l),
        n as (select *, left(line, pos - 1) as name, substr(line, pos + 2) as said from c),
        m as (select *, coalesce(length(name) between 1 and 40 and regexp_full_match(substr(line, pos + 1, 1), '\\s') and not regexp_matches(left(line, 1), '\\s') and not regexp_matches(right(name, 1), '\\s')
            and translate(name, '{{}}[]"''`<>|\\', '') = name and left(name, 1) not in ('-', '*', '#', '>', '|', '+'), false) as cand from n),
        b as (select *, sum(cand::int) over (partition by source order by k) as block from m), g as (select source, block, max(case when cand then name end) as name, trim(string_agg(case when cand then said else line end, chr(10) order by k)) as raw from b where block > 0 group by all),
        s as (select source, name, avg(length(raw)) as mean from g group by all), w as (select *, count(*) over (partition by source) as many, count(*) filter (mean >= 40) over (partition by source) as long from s),
        known as (select * from w where many <= 6 or mean >= 40 or long = 0), card as (select source, arg_max(name, (mean, name)) as card from known group by 1),
        f as (select m.*, cand and (source, name) in (select (source, name) from known) as starts from m where source in (select source from known)),
        fb as (select *, sum(starts::int) over (partition by source order by k) as block from f), fg as (select source, block, max(case when starts then name end) as name, trim(string_agg(case when starts then said else line end, chr(10) order by k)) as raw from fb where block > 0 group by all)
        select source, cast(row_number() over (partition by source order by block) - 1 as int) as index, name, case when name = card then 'char' else 'user' end as role, raw from fg join card using (source) where raw != ''""",
    "incremental_equals_batch": f"""with t as ({sql_tokens("conversations", "conv_id")}) select word, count(*) as n from t where {SQL_ACCEPT} group by 1 having count(*) >= 2""",
}
