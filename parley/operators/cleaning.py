"""Cleaning of message text: Column expressions for what regular expressions can say, and scans for nested markup and lines.

The order of `clean` matters: input wrappers and a user's own rules go first, then comments, code and data, then tags, then
links and marks, then runs of lines, and white space last. What is inside a row stays there: no text is shuffled. The two
scans run in Arrow batches (`scanning`), all else in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import scanning as S

# Elements of HTML whose tags are removed while their content stays; any other tag is a plug-in's own.
HTML_TAGS = (
    "a abbr b bdi bdo big blockquote br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font h1 h2 h3 h4 h5 h6 hr i img ins kbd label li mark ol "
    "p pre q rp rt ruby s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr"
).split()
#: Elements that make up a whole page, for texts that are pages.
PAGE_TAGS = (*HTML_TAGS, *"html head title meta link body main article nav header footer aside form input button base iframe video audio source picture svg noscript address".split())
# Names of tags around a user's own input.
WRAPPERS = ("用户输入", "本轮输入", "user[_-]?input", "current[_-]?input", "player[_-]?input")
# Keys of JSON schemas, which are no words of a reasoning trace.
SCHEMA_WORDS = "string number boolean object array null true false type value check items properties required enum default format title description schema const ref".split()

WRAPPED = rf"(?is)<([^<>\s/]*(?:{'|'.join(WRAPPERS)})[^<>\s/]*)>(.*?)</\1>"
COMMENT = r"(?s)<!--.*?-->"
DECLARATION = r"<[!?][^>]*>"
FENCE = r"(?s)```.*?```|~~~.*?~~~"
DATA_URI = r"data:[\w.+-]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+"
BASE64_WORD = r"\b[A-Za-z0-9+/]{120,}={0,2}"
STYLE_SCRIPT = r"(?is)<(?:style|script)\b.*?(?:</(?:style|script)\s*>|\z)"
HTML_TAG = r"</?[\p{L}_:][^>]*>"
MACRO = r"(?s)\{\{.*?\}\}"
OOC = r"(?is)\[ooc\s*[:：].*?\]|\(ooc\s*[:：].*?\)|（ooc\s*[:：].*?）|【ooc\s*[:：].*?】"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]*)\]\([^)]*\)"
URL = r"(?i)\bhttps?://\S+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
BACKTICKS = r"`([^`]*)`"
LINE_MARKS = r"(?m)^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-+][ \t]+)"
EMPHASIS = r"[*_~`]+"

# Character references by name, each with the character it stands for.
ENTITIES = (
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"),
    ("ldquo", "“"), ("rdquo", "”"), ("lsquo", "‘"), ("rsquo", "’"), ("amp", "&"),
)

#: Repeated lines up to this many are part of the expression.
MOST_REPEATED = 500


@dataclass(frozen=True)
class CleanOptions:
    """Which optional stages of `clean` run, and which tags count as markup of a text itself."""

    custom_tags: bool = True
    code_blocks: bool = True
    structured_lines: bool = True
    ooc: bool = True
    html: tuple[str, ...] = tuple(HTML_TAGS)


PAGES = CleanOptions(html=PAGE_TAGS)


@dataclass(frozen=True)
class Rule:
    """A user's own pattern and what takes its place. placement: the kinds of text it is for (1 user, 2 character, 6
    reasoning; none: all). trims: taken out of what the replacement quotes."""

    find: str
    replace: str = ""
    flags: str = "g"
    placement: tuple[int, ...] = ()
    markdown_only: bool = False
    trims: tuple[str, ...] = ()


def spaced(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, " ")
    return text


def unwrapped(text: Column) -> Column:
    """What stands inside a wrapper of the user's own input, where there is one."""
    held = F.regexp_extract(text, WRAPPED, 2)
    return F.when(text.contains("<") & text.rlike(WRAPPED), F.trim(held)).otherwise(text)


def apply_rules(text: Column, rules: tuple[Rule, ...], placement: Column | None = None) -> Column:
    """The text after each rule in turn. A rule that would take nearly all of a longer text is left out for that text."""
    for rule in rules:
        marks = "".join(sorted(set(rule.flags) & set("ims")))
        if rule.trims and "$" in rule.replace:
            after = scanned(text, lambda t, rule=rule, marks=marks: S.replaced(t, rule.find, marks, rule.replace, rule.trims))
        else:
            pattern = f"(?{marks}){rule.find}" if marks else rule.find
            after = F.regexp_replace(text, pattern, rule.replace)
        emptied = (F.length(after) < F.length(text) * 0.1) & (F.length(text) > 200)
        applies = ~emptied
        if placement is not None and rule.placement:
            applies = applies & placement.isin(*rule.placement)
        text = F.when(applies, after).otherwise(text)
    return text


def decode_entities(text: Column) -> Column:
    """References by name, decimal and hexadecimal ones; a name or a number that stands for nothing becomes a blank."""
    out = text
    for name, char in ENTITIES[:-1]:
        out = F.regexp_replace(out, f"(?i)&{name};", char)
    parts = F.split(F.regexp_replace(out, r"(?i)&(?!amp;)[a-z][a-z0-9]*;", " "), r"(?=&#)")
    number = lambda p: F.regexp_extract(p, r"^&#([xX][0-9A-Fa-f]+|[0-9]+);", 1)
    code = lambda n: F.when(F.lower(n).startswith("x"), F.conv(F.substring(n, 2, 12), 16, 10)).otherwise(n).try_cast("int")
    valid = lambda n: (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    shown = lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    one = lambda p: F.concat(F.coalesce(shown(code(number(p))), F.lit(" ")), F.regexp_replace(p, r"^&#[xX]?[0-9A-Fa-f]+;", ""))
    out = F.array_join(F.transform(parts, lambda p: F.when(number(p) != "", one(p)).otherwise(p)), "")
    return F.when(text.contains("&"), F.regexp_replace(out, "(?i)&amp;", "&")).otherwise(text)


def strip_tags(text: Column) -> Column:
    return spaced(text, HTML_TAG)


def strip_links(text: Column) -> Column:
    return F.regexp_replace(spaced(text, IMAGE), LINK, "$1")


def collapse(text: Column) -> Column:
    """Runs of blanks become one, three or more line ends two; no blanks at line ends."""
    text = F.regexp_replace(text, "[ \t\u00a0]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def scanned(text: Column, *steps) -> Column:
    """The text after steps from text to text, one after the other, in Arrow batches."""

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t:
                for step in steps:
                    t = step(t)
            return t

        return texts.map(one, na_action="ignore")

    return scan(text)


def without_runs(text: Column, hit, least: int = 3, over_blanks: bool = False) -> Column:
    """The text without lines that stand in runs of at least `least` for which hit(line) holds."""
    return scanned(text, lambda t: S.without_runs(t, hit, least, over_blanks))


def without_structured(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not S.is_structured(x))


def strip_custom_tags(text: Column, html: tuple[str, ...] = tuple(HTML_TAGS)) -> Column:
    """Plug-in elements with their content, nested to any depth, and what an unmatched end or start tag of one leaves."""
    known = frozenset(html)
    return scanned(text, lambda t: S.without_custom_tags(t, known))


def clean(text: Column, options: CleanOptions = CleanOptions(), rules: tuple[Rule, ...] = (), placement: Column | None = None) -> Column:
    """The whole cleaning of a message. A null text is empty."""
    known = frozenset(options.html)
    text = apply_rules(unwrapped(F.coalesce(text, F.lit(""))), rules, placement)
    text = spaced(text, COMMENT, DECLARATION, *([FENCE] if options.code_blocks else []), DATA_URI, BASE64_WORD)
    markup = [S.without_json]
    if options.custom_tags:
        text = spaced(text, STYLE_SCRIPT)
        markup += [S.without_details, lambda t: S.without_custom_tags(t, known)]
    text = scanned(text, *markup, S.without_colon_fences, S.without_instruct)
    text = decode_entities(strip_tags(text))
    if options.ooc:
        text = spaced(text, OOC)
    text = strip_links(spaced(text, MACRO))
    text = F.regexp_replace(spaced(text, URL, EMAIL), BACKTICKS, "$1")
    by_line = [lambda t: S.without_runs(t, S.is_code, 3, over_blanks=True)] if options.code_blocks else []
    if options.structured_lines:
        by_line += [S.without_status, S.without_bracket_status, S.without_wrapped, lambda t: S.without_runs(t, S.is_panel, 3)]
        by_line += [lambda t: S.without_runs(t, S.is_indented, 3, over_blanks=True), without_structured]
    if by_line:
        text = scanned(text, *by_line)
    return collapse(spaced(text, LINE_MARKS, EMPHASIS))


def clean_reasoning(traces: DataFrame, options: CleanOptions = CleanOptions(), rules: tuple[Rule, ...] = (), ratio: float = 0.25) -> DataFrame:
    """id, text (a reasoning trace each) -> id, text, cleaned; printed JSON and sentences that a good share of the traces repeat go
    as well, and traces of which nothing is left."""
    first = without_runs(clean(F.col("text"), options, rules, F.lit(6)), S.is_json_line, 2)
    base = traces.select("id", first.alias("text"))
    return strip_boilerplate(base, boilerplate(base, ratio)).where(F.trim("text") != "")


def strip_boilerplate(texts: DataFrame, found: DataFrame) -> DataFrame:
    """id, text -> the same without the sentences of `found` (sentence, n), one sentence a line. At most 1 / ratio sentences of each text
    are in it, so it is put beside each text as one array, whose size is bounded by that of a text."""
    bad = found.agg(F.collect_set("sentence").alias("bad"))
    kept = F.array_join(F.filter(sentences(F.col("text")), lambda x: ~F.array_contains("bad", x)), "\n")
    return texts.crossJoin(F.broadcast(bad)).select("id", F.when(F.size("bad") == 0, F.col("text")).otherwise(kept).alias("text"))


def repeated_lines(texts: DataFrame, key: str = "id", ratio: float = 0.25, least: int = 5, length: int = 6) -> DataFrame:
    """line, n: trimmed lines of `length` characters or more that at least max(least, ceil(ratio * texts)) texts hold."""
    n_texts = texts.agg(F.count("*").alias("n_texts"))
    each = texts.select(key, F.explode(F.array_distinct(F.transform(lines(F.col("text")), lambda x: F.trim(x)))).alias("line")).where(F.length("line") >= length)
    counted = each.groupBy("line").agg(F.count("*").alias("n")).crossJoin(n_texts)
    return counted.where((F.col("n_texts") >= least) & (F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("n_texts") * ratio)))).select("line", "n")


def strip_repeated(texts: DataFrame, key: str = "id", ratio: float = 0.25, least: int = 5) -> DataFrame:
    """texts without their repeated lines. At most 1 / ratio lines of each text's worth can be repeated, so the list of them is put
    beside each text; where `ratio` is so small that it has more than MOST_REPEATED lines, lines are joined with it instead. Either way
    each row keeps its own text, whatever ids repeat or are null."""
    found = repeated_lines(texts, key, ratio, least).select(F.col("line").alias("bad"))
    some = found.limit(MOST_REPEATED + 1).agg(F.collect_set("bad").alias("bad")).first()["bad"]
    if len(some) <= MOST_REPEATED:
        kept = F.filter(lines(F.col("text")), lambda x: ~F.trim(x).isin(some)) if some else lines(F.col("text"))
        return texts.select(key, F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("text"))
    # every distinct row by its key and digest, and each row gets its own text back
    digest = F.sha2("text", 256).alias("digest")
    each = texts.dropDuplicates([key, "text"]).select(key, digest, F.posexplode(lines(F.col("text"))).alias("k", "line"))
    kept = each.join(found, F.trim("line") == F.col("bad"), "left_anti")
    whole = F.array_sort(F.collect_list(F.struct("k", "line")))
    joined = kept.groupBy(F.col(key).alias("_key"), F.col("digest").alias("_digest")).agg(F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("text"))
    rows = texts.select(key, digest)
    same = rows[key].eqNullSafe(joined["_key"]) & rows["digest"].eqNullSafe(joined["_digest"])
    return rows.join(joined, same, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"([。！？；\n]|[.!?]\s)", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def boilerplate(texts: DataFrame, ratio: float = 0.25, length: int = 12, least: int = 4) -> DataFrame:
    """sentence, n: sentences that at least max(2, ceil(ratio * texts)) texts hold."""
    n_texts = texts.agg(F.count("*").alias("n_texts"))
    each = texts.select(F.explode(F.array_distinct(sentences(F.col("text")))).alias("sentence")).where(F.length("sentence") >= length)
    counted = each.groupBy("sentence").agg(F.count("*").alias("n")).crossJoin(n_texts)
    return counted.where((F.col("n_texts") >= least) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("n_texts") * ratio)))).select("sentence", "n")
