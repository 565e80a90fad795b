"""Looking into the texts: context snippets, long samples, word search and display sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import layout as L
from parley.operators import review as R
from parley.operators import sharing as S
from parley.plans.similarity import _ALL, _all_words
from parley.session import table

WORD, AROUND = "clown", 60
SMALLEST, LARGEST, STEPS = 14.0, 96.0, 6


def context_snippets(spark, sf_dir):
    """Every use of a word in the documents, with what stands around it."""
    return R.contexts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), WORD, AROUND)


def longest_samples(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where((F.col("role") == "assistant") & (F.length("text") > 200)).orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(5).select("conv_id", "turn", F.length("text").alias("n_chars"))


def text_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 80)
    return rows.agg(F.min_by(F.left("text", F.lit(600)), "doc_id").alias("sample"))


def word_search(spark, sf_dir):
    return R.review(_all_words(spark, sf_dir), needle="th")


def font_size_step(spark, sf_dir):
    """The display size of each word, and its step on the colour ramp by rank."""
    return L.display_sizes(_all_words(spark, sf_dir), SMALLEST, LARGEST, STEPS)


def collated_ranks(spark, sf_dir):
    """The place of each word by its uses, and among equal ones as a dictionary has them."""
    return L.ranked(_all_words(spark, sf_dir).where(F.col("word").rlike("^[a-z]+$")), F.desc("n"), collation="UNICODE").select("word", "n", "place")


def export_rows(spark, sf_dir):
    """Lines of the CSV export: quotes doubled, fields quoted where they need to be."""
    words = _all_words(spark, sf_dir).select("word", "n", F.lit("plain").alias("kind"), (F.col("n") % 2 == 0).alias("priority"))
    return S.csv_lines(words).select("line")


QUERIES = {"context_snippets": context_snippets, "longest_samples": longest_samples, "text_sample": text_sample, "word_search": word_search, "font_size_step": font_size_step, "collated_ranks": collated_ranks, "export_rows": export_rows}
ORACLES = {
    "context_snippets": rf"""with f as (select doc_id as id, text, string_split(lower(text), '{WORD}') as parts from documents where contains(lower(text), '{WORD}')),
        u as (select id, text, unnest(range(1, len(parts))) as use, unnest(list_transform(range(1, len(parts)), lambda k: length(array_to_string(parts[1:k], '{WORD}')) + 1)) as k from f)
        select id, cast(use as int) as use, cast(k as int) as at, regexp_replace(substring(text, greatest(1, k - {AROUND}), k - greatest(1, k - {AROUND}) + {len(WORD) + AROUND}), '\s+', ' ', 'g') as snippet from u""",
    "longest_samples": "select conv_id, turn, cast(length(text) as int) as n_chars from conversations where role = 'assistant' and length(text) > 200 order by length(text) desc, conv_id, turn limit 5",
    "text_sample": "select arg_min(left(text, 600), doc_id) as sample from documents where length(text) > 80",
    "word_search": f"with {_ALL} select word, n from w where contains(lower(word), 'th')",
    "font_size_step": f"""with {_ALL} select word, round({SMALLEST} + {LARGEST - SMALLEST} * sqrt(n / max(n) over ()), 6) as size,
        cast(least({STEPS - 1}, floor((row_number() over (order by n desc, word) - 1) * {STEPS} / count(*) over ())) as int) as step from w""",
    "collated_ranks": f"with {_ALL} select word, n, row_number() over (order by n desc, word) - 1 as place from w where regexp_full_match(word, '[a-z]+')",
    "export_rows": f"""with {_ALL} select case when regexp_matches(word, '[",\\n]') then '"' || replace(word, '"', '""') || '"' else word end || ',' || n || ',plain,' || case when n % 2 = 0 then 'priority' else 'tokenizer' end as line from w""",
}
