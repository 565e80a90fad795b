"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import cleaning as C
from parley.operators import scanning as S
from parley.session import table


# The tables hold few of the shapes that are cleaned away, so each query adds some to each whole text, by an expression that both
# engines read.
_ID = "cast(doc_id as string)"
SHAPES = {
    "urls": f"concat(text, ' see http://x.example/', {_ID}, '?q=1#a or HTTPS://Y.example. End')",
    "emails": f"concat(text, ' write to a.b+', {_ID}, '@mail.example.org, please')",
    "links": f"concat(text, ' see [page ', {_ID}, '](http://x.example/', {_ID}, ') and ![pic](a.png) then [open end')",
    "backticks": f"concat(text, ' run `code ', {_ID}, '` and ```block ', {_ID}, '``` then ` one')",
    "base64": f"concat(text, ' pic data:image/png;base64,', repeat('iVBORw0KGgo', 1 + doc_id % 5), ' and ', repeat('Abc1', 20 + doc_id % 20), ' end')",
    "macros": f"concat(text, ' {{{{char}}}} says [OOC: note ', {_ID}, '] so (ooc: x) and {{{{roll ', {_ID}, '}}}} {{{{ open')",
    "entities": f"concat(text, ' &lt;b&gt; &#', cast(65 + doc_id % 26 as string), '; &#x1F600; &unknown; &amp;lt; &QUOT; &hellip;')",
    "lines": f"concat(text, chr(10), '| a | ', {_ID}, ' |', chr(10), '|---|---|', chr(10), ' [status ', {_ID}, '] ', chr(10), 'a | b', chr(10), '[not a title] but text', chr(10), '====')",
    "panel": f"concat(text, chr(10), 'hp ', {_ID}, chr(10), 'mana pool 12', chr(10), case when doc_id % 2 = 0 then 'gold 7' else 'gold coins' end, chr(10), 'end', chr(10), 'x 1', chr(10), 'y 2')",
}


def shaped(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(SHAPES[shape]).alias("text"))


def _pages(spark: SparkSession, sf_dir: str, change) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", change(F.col("html")).alias("text"))


def _documents(spark: SparkSession, sf_dir: str, change, shape: str | None = None) -> DataFrame:
    rows = shaped(spark, sf_dir, shape) if shape else table(spark, sf_dir, "documents")
    text = change(F.col("text"))
    return rows.select("doc_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def strip_comments(spark, sf_dir):
    return _pages(spark, sf_dir, lambda t: C.spaced(t, C.COMMENT))


def strip_declarations(spark, sf_dir):
    return _pages(spark, sf_dir, lambda t: C.spaced(t, C.DECLARATION))


def strip_style_script(spark, sf_dir):
    return _pages(spark, sf_dir, lambda t: C.spaced(t, C.STYLE_SCRIPT))


def strip_html(spark, sf_dir):
    return _pages(spark, sf_dir, lambda t: C.strip_tags(C.spaced(t, C.COMMENT)))


def decode_entities(spark, sf_dir):
    return _documents(spark, sf_dir, C.decode_entities, "entities")


def strip_urls(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: C.spaced(t, C.URL), "urls")


def strip_emails(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: C.spaced(t, C.EMAIL), "emails")


def strip_md_links(spark, sf_dir):
    return _documents(spark, sf_dir, C.strip_links, "links")


def collapse_ws(spark, sf_dir):
    return _documents(spark, sf_dir, C.collapse)


def unwrap_backticks(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: F.regexp_replace(C.spaced(t, C.FENCE), C.BACKTICKS, "$1"), "backticks")


def strip_base64(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: C.spaced(t, C.DATA_URI, C.BASE64_WORD), "base64")


def strip_macros_ooc(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: C.spaced(t, C.MACRO, C.OOC), "macros")


def structured_line_filter(spark, sf_dir):
    return _documents(spark, sf_dir, lambda t: C.scanned(t, C.without_structured), "lines")


def line_runs(spark, sf_dir):
    """Texts without the runs of panel lines, by the length of what is left."""
    return _documents(spark, sf_dir, lambda t: C.without_runs(t, S.is_panel), "panel")


def _text(*lines: str) -> str:
    """SQL for lines, one below the other."""
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in lines) + ")"


# A kind of pollution each: what is put below a message, and what is to be left of both; {text} is the message.
POLLUTION = (
    (_text("<think>", "a secret plan of it", "</think>", "She smiled."), "concat({text}, ' She smiled.')"),
    (_text("| Place | Mood |", "|---|---|", "| Hall | calm |", "Time: noon", "Place: hall", "HP: 10/20", "[status]", "He left."), "concat({text}, ' He left.')"),
    (_text("[World: old kingdom", "Rules: many", "Law: none", "]", "They walked on."), "concat({text}, ' They walked on.')"),
    (_text("### Instruction:", "write more", "### Response:", "The rain went on.", "<|im_end|>", "[INST] say it [/INST]"), "concat({text}, ' The rain went on.')"),
    (_text("hp low, mood bad</status_vars>", "Only this is said."), "'Only this is said.'"),
    (_text("He waits.", "<UpdateVariable>", "x = 1"), "concat({text}, ' He waits.')"),
    (_text("One <x><x><x><x>in</x></x></x></x> two."), "concat({text}, ' One two.')"),
    (_text('Now {"mood": {"joy": 3, "fear": [1, 2]}, "place": "hall"} she sings.'), "concat({text}, ' Now she sings.')"),
    (_text("<details><summary>Status</summary>hp 3</details>", "<details><summary>A tale</summary>Once upon.</details>"), "concat({text}, ' A tale Once upon.')"),
    (_text(":::note", "hidden words here", ":::", "Seen words here."), "concat({text}, ' Seen words here.')"),
    (_text("A picture data:image/png;base64,iVBORw0KGgoAAAANSUhEUg== of her."), "concat({text}, ' A picture of her.')"),
    (_text("She {{random}} nods [OOC: stop here] and (OOC: go) goes."), "concat({text}, ' She nods and goes.')"),
    (_text(".box {", "  color: red;", "  margin: 0 auto;", "}", "const a = f(1);", "Then we ate."), "concat({text}, ' Then we ate.')"),
    (_text("[时间] noon of the day", "[地点] the old hall", "So it ends."), "concat({text}, ' So it ends.')"),
    (_text("  name: Ann", "  age: 31", "", "  home: far", "We met."), "concat({text}, ' We met.')"),
    (_text("<current_input>", "I open the door.", "</current_input>", "rules of the game"), "'I open the door.'"),
)
_MESSAGE = "conv_id * 8 + turn"
_POLLUTED = "concat(text, chr(10), case (" + _MESSAGE + f") % {len(POLLUTION)} " + " ".join(f"when {k} then {block}" for k, (block, _) in enumerate(POLLUTION)) + " end)"


def clean_full(spark, sf_dir):
    """Each message with a kind of pollution below it, cleaned; white space is made one blank."""
    text = F.trim(F.regexp_replace(C.clean(F.expr(_POLLUTED)), r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def clean_pages(spark, sf_dir):
    return _pages(spark, sf_dir, lambda t: C.clean(t, C.PAGES))


RULES = (C.Rule(r"the (\w+) of", "$1 of"), C.Rule("AND", "&", "gi"), C.Rule("[a-z ]+", "", "g"), C.Rule("x+", "", "g", (1,)))


def apply_rules(spark, sf_dir):
    """A user's own rules, of which one would empty texts and one is for users' messages only."""
    placement = F.when(F.col("role") == "user", 1).otherwise(2)
    text = C.apply_rules(F.col("text"), RULES, placement)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def _card_texts(spark, sf_dir):
    """Conversations as texts of one card each, turn after turn."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")


def repeated_lines(spark, sf_dir):
    return C.repeated_lines(_card_texts(spark, sf_dir), ratio=0.0, least=2)


def strip_repeated(spark, sf_dir):
    return C.strip_repeated(_card_texts(spark, sf_dir), ratio=0.0, least=2)


def repeated_doc_lines(spark, sf_dir):
    return C.repeated_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ratio=0.005, least=5)


def boilerplate_sentences(spark, sf_dir):
    return C.boilerplate(table(spark, sf_dir, "documents").select("text"), ratio=0.005)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_spaced(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, {_sql(pattern)}, ' ', 'g')"
    return text


def _sql_pages(text: str) -> str:
    return f"select page_id, {text} as text from pages"


def _sql_documents(text: str, shape: str | None = None) -> str:
    rows = f"(select doc_id, {SHAPES[shape]} as text from documents)" if shape else "documents"
    return f"select doc_id, cast(length(t) as int) as n_chars, md5(t) as digest from (select doc_id, {text} as t from {rows})"


_SQL_ENTITIES = "text"
for _name, _char in C.ENTITIES[:-1]:
    _SQL_ENTITIES = f"regexp_replace({_SQL_ENTITIES}, '(?i)&{_name};', {_sql(_char)}, 'g')"
# the shapes hold these numbers only
for _k in range(26):
    _SQL_ENTITIES = f"replace({_SQL_ENTITIES}, '&#{65 + _k};', '{chr(65 + _k)}')"
_SQL_ENTITIES = f"regexp_replace(replace(replace({_SQL_ENTITIES}, '&#x1F600;', chr(128512)), '&amp;', chr(1)), '&[A-Za-z][A-Za-z0-9]*;', ' ', 'g')"
_SQL_ENTITIES = f"replace({_SQL_ENTITIES}, chr(1), '&')"
_SQL_COLLAPSE = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{00a0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))"
_T = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_STRUCTURED = rf"""{_T} != '' and ((length({_T}) - length(replace({_T}, '|', '')) >= 2 and (left({_T}, 1) = '|' or contains({_T}, '[') or contains({_T}, '{{')))
    or (length({_T}) > 3 and translate({_T}, '|+-=: ', '') = '') or (left({_T}, 1) in ('[', '{{', '【') and right({_T}, 1) in (']', '}}', '】') and length({_T}) between 2 and 42
    and translate(substr({_T}, 2, length({_T}) - 2), ']}}】', '') = substr({_T}, 2, length({_T}) - 2)))"""
_SQL_PANEL = rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from (select doc_id, {SHAPES["panel"]} as text from documents)),
    h as (select *, regexp_full_match(x, '\s*([\p{{L}}\p{{N}}_-]{{1,20}}\s+)+[0-9]{{1,5}}\s*') as hit from l), g as (select *, k - row_number() over (partition by doc_id, hit order by k) as island from h),
    r as (select *, count(*) over (partition by doc_id, hit, island) as size from g),
    kept as (select doc_id, string_agg(x, chr(10) order by k) as t from r where not (hit and size >= 3) group by 1)
    select doc_id, cast(length(t) as int) as n_chars, md5(t) as digest from kept"""
_SQL_MARKED = rf"regexp_replace(regexp_replace(text, '(?m)^[ \t]{{0,3}}(#{{1,6}}[ \t]+|>[ \t]?|[-+][ \t]+)', ' ', 'g'), '[*_~`]+', ' ', 'g')"
_SQL_FULL = "case (" + _MESSAGE + f") % {len(POLLUTION)} " + " ".join(f"when {k} then {left.format(text='t')}" for k, (_, left) in enumerate(POLLUTION)) + " end"
_CARDS = "(select conv_id * 100 + turn as id, text from conversations)"


def _sql_repeated(source: str, ratio: float, least: int) -> str:
    return f"""select line, count(*) as n from (select distinct id, trim(unnest(string_split(text, chr(10)))) as line from {source}) where length(line) >= 6
        group by line having count(*) >= greatest({least}, ceil((select count(*) from {source}) * {ratio}))"""


QUERIES = {
    "strip_comments": strip_comments, "strip_declarations": strip_declarations, "strip_style_script": strip_style_script, "strip_html": strip_html, "decode_entities": decode_entities,
    "strip_urls": strip_urls, "strip_emails": strip_emails, "strip_md_links": strip_md_links, "collapse_ws": collapse_ws, "unwrap_backticks": unwrap_backticks, "strip_base64": strip_base64,
    "strip_macros_ooc": strip_macros_ooc, "structured_line_filter": structured_line_filter, "clean_full": clean_full, "clean_pages": clean_pages, "line_runs": line_runs,
    "apply_rules": apply_rules, "repeated_lines": repeated_lines, "strip_repeated": strip_repeated, "repeated_doc_lines": repeated_doc_lines, "boilerplate_sentences": boilerplate_sentences,
}
ORACLES = {
    "strip_comments": _sql_pages(_sql_spaced("html", C.COMMENT)),
    "strip_declarations": _sql_pages(_sql_spaced("html", C.DECLARATION)),
    "strip_style_script": _sql_pages(_sql_spaced("html", C.STYLE_SCRIPT)),
    "strip_html": _sql_pages(_sql_spaced("html", C.COMMENT, C.HTML_TAG)),
    "decode_entities": _sql_documents(_SQL_ENTITIES, "entities"),
    "strip_urls": _sql_documents(r"regexp_replace(text, '(?i)\bhttps?://[^\s]+', ' ', 'g')", "urls"),
    "strip_emails": _sql_documents(_sql_spaced("text", C.EMAIL), "emails"),
    "strip_md_links": _sql_documents(r"regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')", "links"),
    "collapse_ws": _sql_documents(_SQL_COLLAPSE),
    "unwrap_backticks": _sql_documents(r"regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', ' ', 'g'), '`([^`]*)`', '\1', 'g')", "backticks"),
    "strip_base64": _sql_documents(r"regexp_replace(regexp_replace(text, 'data:[\w.+-]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+', ' ', 'g'), '\b[A-Za-z0-9+/]{120,}={0,2}', ' ', 'g')", "base64"),
    "strip_macros_ooc": _sql_documents(r"regexp_replace(regexp_replace(text, '(?s)\{\{.*?\}\}', ' ', 'g'), '(?is)\[ooc:.*?\]|\(ooc:.*?\)', ' ', 'g')", "macros"),
    "structured_line_filter": _sql_documents(f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: not ({_STRUCTURED})), chr(10))", "lines"),
    "line_runs": _SQL_PANEL,
    "clean_full": rf"select conv_id, turn, trim(regexp_replace({_SQL_FULL}, '\s+', ' ', 'g')) as text from (select conv_id, turn, {_SQL_MARKED} as t from conversations)",
    "apply_rules": r"""with a as (select *, regexp_replace(text, 'the (\w+) of', '\1 of', 'g') as b from conversations), c as (select *, regexp_replace(b, 'and', '&', 'gi') as d from a),
        e as (select *, regexp_replace(d, '[a-z ]+', '', 'g') as f from c), g as (select *, case when length(f) < length(d) * 0.1 and length(d) > 200 then d else f end as h from e)
        select conv_id, turn, case when role = 'user' and not (length(regexp_replace(h, 'x+', '', 'g')) < length(h) * 0.1 and length(h) > 200) then regexp_replace(h, 'x+', '', 'g') else h end as text from g""",
    "repeated_lines": _sql_repeated(_CARDS, 0.0, 2),
    "strip_repeated": f"""with bad as (select coalesce(list(line), []) as bad from ({_sql_repeated(_CARDS, 0.0, 2)}))
        select id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(bad, trim(x))), chr(10)), '') as text from {_CARDS} cross join bad""",
    "repeated_doc_lines": _sql_repeated("(select doc_id as id, text from documents)", 0.005, 5),
    "boilerplate_sentences": r"""with s as (select distinct doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([。！？；\n]|[.!?]\s)', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g')) as sentence from documents)
        select sentence, count(*) as n from s where length(sentence) >= 12 group by 1 having count(*) >= greatest(2, ceil((select count(*) from documents) * 0.005)) and (select count(*) from documents) >= 4""",
}
