"""Names by their places in sentences, brands by what stands near them, and short forms that stand for a full name.

Names. Each pattern is a row of a table: where it matches, the Han characters before it may be a name. What counts is in how many
patterns a name is found and how often; a word that the dictionary knows needs more of both. A name that another candidate begins,
found at least as often and in as many patterns, has swallowed a character and goes: a join on the name without its last character.

Brands. Runs of the characters that transliterations are written with, by the distance to a word of trade in the same text, which
one pattern tells at each run: it looks at most REACH characters back and on.

Short forms. All forms of all full names are looked for at once by one automaton, in one pass over the texts; the tests are joins and
sums of its hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.session import cut

HAN = r"[一-鿿]"
_NAME = rf"({HAN}{{2,4}})"
# The places of names.
PLACES = (
    ("says", _NAME + '(?:说道|问道|答道|说|问|答|道)[，。："]'),
    ("gesture", _NAME + "(?:点了点头|摇了摇头|皱了皱眉|点点头|摇摇头|皱眉|抬头|低头|叹了口气|笑了笑)"),
    ("possessive", _NAME + "的(?:声音|眼睛|手|脸|目光|背影|语气|肩膀|表情)"),
    ("quoted", r'["]\s*' + _NAME + "(?:说|问|道)"),
    ("address", _NAME + "[，,](?:你|我|这|那)"),
    ("toward", "(?:和|跟|对|向|给|被)" + _NAME + "(?:说|问|点|笑|看)"),
    (
        "subject",
        _NAME
        + "(?:是|从|看|望|站|坐|走|抬|低|转|伸|皱|笑|叹|喊|叫|想|开始|接管|允许|采纳|发|知道|觉得|没有|已经|正在|突然|轻轻|缓缓|慢慢|猛地|微微|把|被|让|对|向|朝|跟|和|与|在|用|将|也|却|还|只|又|便|就|才|则|会|能|要|去|来|回|拿|放|推|拉|打|抓|握|摸|吻|抱|靠|躺|睡|醒|哭|停|等|听|闻|咬|舔|喝|吃|穿|脱|翻|拍|指|挥|掀|拧|扯|拽|扶|搂|蹲|跪|爬|跑|跳|冲|退|进|出|上|下)",
    ),
    ("vocative", "[“\"「]" + _NAME + "[，,！!？?、]"),
    ("label", r"(?:^|\n)\s*" + _NAME + "[：:]"),
)
# Characters that do not begin, end or belong to a name, and words that are none.
HEAD = "的了在是和都也就还又很不个们过着与把被向对从但而且或到当让给跟比你我他她它您咱谁"
HEAD_VERBS = "见看找问叫喊等送接陪跟带劝骂夸推拉抱"
INSIDE, END = "以于之乎者及或而且但则即若", "色后前里中边旁上下内外"
TAIL = "的了没在是和都也就还又很不个们过着与把被向对从地得"
NOUN_END = "板面衫沙台门口手星部布巾件本杯器椅牌表夹箱凳树声场室馆人子理生戏款机灯纸袋墙窗桌硬露"
FRAGMENT = "完彻受另大条一最更太极超挺"
KIN = "妈妈 母亲 爸爸 父亲 儿子 女儿 哥哥 姐姐 弟弟 妹妹 爷爷 奶奶 外公 外婆 姥姥 姥爷 叔叔 阿姨 舅舅 姑姑 老公 老婆 丈夫 妻子 孩子 男人 女人 老师 学生 同学 医生 护士 警察 师傅 老板 经理 主任 导演 演员 助理".split()
ADDRESS = "主人 小主人 陛下 殿下 大人 老爷 夫人 小姐 少爷 公子 姑娘 先生 女士 老板 队长 教官 长官 阁下 师父 师傅 前辈 学长 学姐 宝贝 亲爱的".split()
TITLES = "总 老师 导演 副导演 经理 医生 律师 主任 哥 姐 叔 姨 先生 小姐 女士 同学 队长 教授".split()
SHORT_TITLES, HONORIFICS = ["导"], ["Mr.", "Mrs.", "Ms.", "Miss", "Dr."]
COMPOUND = "欧阳 司马 上官 慕容 诸葛 司徒 皇甫 独孤 尉迟 长孙 宇文 夏侯 东方 西门 南宫 公孙 轩辕 端木 澹台".split()
FULL_LATIN = r"^\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}?\p{Ll}+)? \p{Lu}\p{Ll}+(?:[-'’]\p{Lu}?\p{Ll}+)?$"
CORPORATE, TRADE, REACH = ("牌", "公司", "集团", "工作室", "官方"), "穿买牌款", 12
SYSTEM = ("user", "User", "assistant", "Assistant", "char", "system")


@dataclass(frozen=True)
class Bounds:
    """How much evidence is asked for."""

    uses: int = 3
    unknown_patterns: int = 2
    unknown_uses: int = 4
    patterns: int = 3
    strongest: int = 8
    brand_uses: int = 3
    full_names: int = 24
    confidence: int = 4
    share: float = 0.15
    alone: float = 0.25
    candidates: int = 100_000


def transliterated(word: Column, characters: str) -> Column:
    """All characters but one at most, and two at least, are of those that transliterations use."""
    if not characters:
        return F.lit(False)
    n = F.length(word) - F.length(F.translate(word, characters, ""))
    return (n >= 2) & (n >= F.length(word) - 1)


def evidence(texts: DataFrame, places: tuple[tuple[str, str], ...] = PLACES) -> DataFrame:
    """name, place, n: how often each pattern has a name."""
    found = [F.struct(F.lit(k).alias("place"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("names")) for k, p in places]
    rows = texts.select(F.inline(F.array(*found))).select("place", F.explode("names").alias("name"))
    whole = F.regexp_replace("name", f"^[{HEAD}]+", "")
    cut = F.regexp_replace(whole, f"^[{HEAD_VERBS}]+", "")
    name = F.when(F.length(cut) >= 2, cut).otherwise(whole)
    return rows.select("place", name.alias("name")).where(F.length("name") >= 2).groupBy("name", "place").agg(F.count("*").alias("n"))


def no_name(word: Column) -> Column:
    """Whether the characters of a word keep it from being a name."""
    return word.isin(*KIN, *ADDRESS) | word.rlike(f"[{INSIDE}]|[{END}]$|[{NOUN_END}]$|[{TAIL}]$") | word.isin(*T.STOP_WORDS)


def persons(texts: DataFrame, unknown: Column, bounds: Bounds = Bounds(), vetoed: Column | None = None) -> DataFrame:
    """text -> name, places, n. unknown, vetoed: of the column `name`, whether the dictionary knows it only as several words, and
    whether it is a word of a kind that is no person."""
    all_names = evidence(texts).groupBy("name").agg(F.count("*").alias("places"), F.sum("n").alias("n"), F.max("n").alias("strongest"))
    b = bounds
    strange = ((F.col("places") >= b.unknown_patterns) & (F.col("n") >= b.unknown_uses)) | (F.col("strongest") >= b.unknown_uses)
    common = (F.col("places") >= b.patterns) | (F.col("strongest") >= b.strongest)
    named = all_names.where(F.col("n") >= b.uses).withColumn("unknown", unknown)
    named = named.where(F.when(F.col("unknown"), strange).otherwise(common) & ~no_name(F.col("name")) & ~(F.lit(False) if vetoed is None else vetoed))
    named = named.where(~F.col("name").rlike(f"^[{FRAGMENT}]") | (F.col("unknown") & (F.col("places") >= b.patterns)))
    begun = all_names.select(F.col("name").alias("begin"), F.col("places").alias("begin_places"), F.col("n").alias("begin_n"))
    swallowed = (F.expr("left(name, length(name) - 1)") == F.col("begin")) & (F.col("begin_places") >= F.col("places")) & (F.col("begin_n") >= F.col("n"))
    return named.join(begun, swallowed, "left_anti").select("name", "places", "n")


def system_words(messages: DataFrame, unknown_name: str = "(unknown)") -> DataFrame:
    """word: the names of speakers, and the usual names of the roles."""
    usual = messages.sparkSession.createDataFrame([(w,) for w in SYSTEM], "word string")
    return messages.where(F.col("name").isNotNull() & (F.col("name") != unknown_name)).select(F.col("name").alias("word")).unionAll(usual).distinct()


def looks_like_person(word: Column, surnames: tuple[str, ...], unknown: Column, characters: str = "") -> Column:
    """A name by its form alone: with a title, as two capitalised words, or as a surname and a given name that no dictionary has."""
    titled = word.rlike(f"^{HAN}{{1,3}}(?:{'|'.join(TITLES)})$")
    headed = F.left(word, F.lit(1)).isin(*surnames) | F.left(word, F.lit(2)).isin(*COMPOUND) | transliterated(word, characters)
    formed = word.rlike(f"^{HAN}{{3,4}}$") & ~no_name(word) & headed & unknown
    return (F.length(word) <= 24) & (titled | word.rlike(FULL_LATIN) | formed)


def latin_brands(texts: DataFrame) -> DataFrame:
    """word: capitalised Latin words before a word for a company, that no text writes in lower case."""
    edge = r"(?:^|[^A-Za-z0-9_])"
    named = texts.select(F.explode(F.regexp_extract_all("text", F.lit(edge + r"([A-Z][A-Za-z0-9&.-]{1,20})\s?(?:" + "|".join(CORPORATE) + ")"), F.lit(1))).alias("w"))
    small = texts.select(F.explode(F.regexp_extract_all("text", F.lit(edge + r"([a-z][a-z0-9&.-]{1,20})"), F.lit(1))).alias("word")).distinct()
    return named.select(F.lower("w").alias("word")).distinct().join(small, "word", "left_anti")


def near_trade(texts: DataFrame, characters: str, key: str = "id", bounds: Bounds = Bounds()) -> DataFrame:
    """word, n: runs of two to five of the characters with a word of trade at most REACH characters away, `brand_uses` times. All of it is
    within a text, so one pattern finds the runs where the text is, and only they are dealt out. key: null for texts that do not count."""
    run = f"[{characters}]{{2,5}}"
    whole = f"(?={run}(?![{characters}]))(?<![{characters}])"  # first what most places fail
    # the excluded character is beyond 16 bits, without which Java's engine counts what is before a place in halves of characters
    before, after = f"(?<=[{TRADE}&&[^\U0010ffff]].{{0,{REACH - 1}}})", f"(?=.{{0,{REACH - 1}}}[{TRADE}])"
    found = texts.where(F.col(key).isNotNull()).select(F.explode(F.regexp_extract_all("text", F.lit(f"(?s){whole}(?:{run}{after}|{before}{run})"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= bounds.brand_uses)


def hits(texts: DataFrame, needles: list[str], key: str = "id") -> DataFrame:
    """key, needle, n: how often each text holds each needle, its uses not overlapping."""
    shared = texts.sparkSession.sparkContext.broadcast(sorted({n for n in needles if n}))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for needle in shared.value:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        for batch in batches:
            at, found, n = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                uses: dict[str, list[int]] = {}
                for end, needle in automaton.iter(text or "") if len(automaton) else ():
                    seen = uses.setdefault(needle, [0, -1])
                    if end - len(needle) >= seen[1]:
                        seen[0], seen[1] = seen[0] + 1, end
                at += [k] * len(uses)
                found += uses
                n += [x[0] for x in uses.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=[key, "needle", "n"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(search, f"{key} {kind}, needle string, n long")


def forms(full: str) -> list[tuple[str, str, str]]:
    """(form, how it is made, title) of a full name."""
    if " " in full:
        first, last = full.split(" ", 1)
        return [(x, "plain", "") for x in (first, last, first + "'s", first + "’s")] + [(f"{h} {last}", "title", h) for h in HONORIFICS]
    surname = full[:2] if full[:2] in COMPOUND else full[:1]
    given = full[len(surname) :]
    made = [(given, "tail", ""), (given[0] * 2, "plain", ""), (given[1] * 2, "plain", "")] if len(given) == 2 else []
    made += [(p + surname, "plain", "") for p in ("小", "老")]
    made += [(surname + t, "title", t) for t in (*TITLES, *SHORT_TITLES)]
    return [x for k, x in enumerate(made) if x[0] != full and x[0] not in {y[0] for y in made[:k]}]


def full_names(texts: DataFrame, names: DataFrame, surnames: tuple[str, ...], unknown, key: str = "id", bounds: Bounds = Bounds()) -> list[str]:
    """The most frequent names, at most `full_names`, that read as complete ones and have enough places. names: name, places."""
    name = F.col("name")
    addressed = name.rlike(f"^{HAN}{{1,3}}(?:{'|'.join(TITLES)})$") | name.rlike(f".(?:{'|'.join(KIN + ADDRESS)})$")
    shaped = names.where(looks_like_person(name, surnames, unknown(name)) & ~addressed & (name.rlike(FULL_LATIN) | (F.col("places") >= bounds.confidence)))
    found = [r["name"] for r in shaped.select("name").distinct().limit(bounds.candidates + 1).collect()]
    if len(found) > bounds.candidates:
        raise ValueError(f"more than {bounds.candidates} names are not looked for at once")
    counted = hits(texts, found, key).groupBy("needle").agg(F.sum("n").alias("n")).where(F.col("n") >= bounds.uses)
    return [r["needle"] for r in counted.orderBy(F.desc("n"), "needle").limit(bounds.full_names).collect()]


def short_forms(texts: DataFrame, names: DataFrame, surnames: tuple[str, ...], unknown, key: str = "id", bounds: Bounds = Bounds()) -> DataFrame:
    """full, alias, n: forms that stand for one full name. names: name, places; unknown: a function of a column of words."""
    spark, b = texts.sparkSession, bounds
    full = full_names(texts, names, surnames, unknown, key, bounds)
    made = [(f, *x) for f in full for x in forms(f)]
    owners: dict[str, int] = {}
    for _, alias, _, _ in made:
        owners[alias] = owners.get(alias, 0) + 1
    titled = [(s + t, t) for s in (*surnames, *COMPOUND) for t in (*TITLES, *SHORT_TITLES)]
    found = cut(hits(texts, [*full, *(x[1] for x in made), *(x[0] for x in titled)], key))
    held = spark.createDataFrame([(a, f) for a in owners for f in full if a != f and a in f], "alias string, holder string")
    own = spark.createDataFrame([x for x in made if owners[x[1]] == 1], "full string, alias string, made string, title string")

    total = found.groupBy("needle").agg(F.sum("n").alias("total"), F.count("*").alias("texts"))
    bearers = spark.createDataFrame(titled, "needle string, title string").join(total.where(F.col("total") >= b.uses), "needle").groupBy("title").agg(F.count("*").alias("bearers"))
    in_holders = found.join(held, found["needle"] == held["holder"]).groupBy(key, "alias").agg(F.sum("n").alias("inside"))
    uses = found.join(own, found["needle"] == own["alias"]).select(key, "full", "alias", "n").join(in_holders, [key, "alias"], "left")
    uses = uses.withColumn("solo", F.greatest(F.lit(0), F.col("n") - F.coalesce("inside", F.lit(0))))
    with_full = found.where(F.col("needle").isin(*full) if full else F.lit(False)).select(key, F.col("needle").alias("full"), F.lit(1).alias("beside"))
    told = uses.join(with_full, [key, "full"], "left").groupBy("full", "alias").agg(
        F.sum("n").alias("total"), F.sum("n").alias("_n"), F.sum(F.coalesce("inside", F.lit(0))).alias("inside"),
        F.count_if(F.col("solo") > 0).alias("texts"), F.count_if((F.col("solo") > 0) & F.col("beside").isNotNull()).alias("both"),
    )
    of_full = total.select(F.col("needle").alias("full"), F.col("texts").alias("full_texts"))
    rows = own.join(told, ["full", "alias"]).join(of_full, "full").join(bearers, "title", "left")
    rows = rows.join(names.select(F.col("name").alias("alias"), F.col("places").alias("alias_places")), "alias", "left").withColumn("n", F.greatest(F.lit(0), F.col("total") - F.col("inside")))

    alias, tail, title = F.col("alias"), F.col("made") == "tail", F.col("made") == "title"
    strange = unknown(alias)
    person = looks_like_person(alias, surnames, strange)
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(1.0)
    trusted = tail & ((share <= b.alone) | (F.coalesce("alias_places", F.lit(0)) >= b.confidence))
    ruled_out = alias.isin(*full, *T.STOP_WORDS, *KIN, *ADDRESS, *TITLES) | (~tail & ~title & person) | (title & (F.coalesce("bearers", F.lit(0)) > 1))
    proven = ~(alias.rlike(f"^{HAN}+$") & ~strange) & ~(tail & person & (share > b.alone)) & (F.col("n") >= b.uses)
    together = (F.col("both") > 0) & (F.col("both") / F.least("full_texts", "texts") >= b.share)
    substitutes = tail | (F.col("both") == 0) | (F.col("texts") > F.col("both"))
    kept = F.when(F.col("texts") == 0, trusted & (F.col("n") < b.uses)).otherwise((trusted | together) & substitutes)
    return rows.where(~ruled_out & (trusted | proven) & kept).select("full", "alias", "n")
