"""Kinds of words: a table of rules that words are joined with, and what is shown or blocked because of them.

A rule is a row: a kind and a whole word, an ending, or a word that the kind's endings do not mean. Words are met with it by the word
itself and by its last one, two and three characters, so the rules are a dimension of any length that is joined by equality, and a
caller's own rows go through the same join. A few forms (numbers, clock times, doubled syllables) are patterns. All that fit are
tags; they are ordered by the confidence of their kinds, `plain` stands where none fits, and a person's name is nothing else. The
lists are this engine's own and short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T

# The kinds with the confidence that orders them.
CONF = {
    "person": 0.95, "time": 0.9, "brand": 0.88, "place": 0.85, "wear": 0.8, "title": 0.7, "kinship": 0.68, "body": 0.66, "org": 0.66, "money": 0.64, "occupation": 0.62,
    "building": 0.6, "room": 0.6, "nature": 0.58, "food": 0.55, "drink": 0.55, "vehicle": 0.54, "furniture": 0.52, "container": 0.52, "relation": 0.5, "color": 0.5, "emotion": 0.5,
    "animal": 0.49, "material": 0.48, "jewelry": 0.47, "texture": 0.46, "festival": 0.46, "weather": 0.45, "plant": 0.44, "illness": 0.43, "myth": 0.43, "martial": 0.42, "desire": 0.42,
    "weapon": 0.41, "device": 0.4, "thought": 0.39, "sound": 0.38, "smell": 0.37, "speech": 0.36, "document": 0.35, "media": 0.34, "event": 0.33,
    "ethnicity": 0.329, "rank": 0.328, "law": 0.327, "measure": 0.326, "onomatopoeia": 0.325, "number": 0.324, "region": 0.323, "path": 0.322,
}


@dataclass(frozen=True)
class Rule:
    """Words of a kind, endings that mean it from `least` characters on, and words that have such an ending and are not of it."""

    kind: str
    words: str = ""
    endings: str = ""
    but: str = ""
    least: int = 2


RULES = (
    Rule("time", "today tomorrow yesterday tonight morning evening night noon midnight monday sunday hour minute week 今天 明天 昨晚 刚才", "年 月 日 分钟 小时 季", "生日 岁月"),
    Rule("brand", "", "牌 集团 有限公司", "门牌 车牌 金牌", 3),
    Rule("place", "city village harbor station square 城市 乡下", "市 镇 村 街 路 港 广场", "一路 思路", 2),
    Rule("wear", "coat dress shirt shoe hat glove sock 围巾", "衣 裤 裙 鞋 帽 袜", "毛衣架", 2),
    Rule("title", "sir lady doctor captain professor madam", "先生 小姐 女士 老师 医生 队长", "", 2),
    Rule("kinship", "mother father sister brother daughter son uncle aunt cousin 妈妈 爸爸 哥哥 姐姐 弟弟 妹妹 奶奶"),
    Rule("body", "hand eye head heart face finger shoulder knee 手 眼睛 脸 头发 肩膀 膝盖"),
    Rule("org", "company army guild union council 警察局 法院", "公司 军团 学会 协会 委员会", "", 3),
    Rule("money", "dollar euro coin cash 工资 零钱", "元 块钱", "单元 公元"),
    Rule("occupation", "teacher soldier baker nurse farmer sailor", "师 员 匠", "一员 老师", 3),
    Rule("building", "house tower castle church school temple", "楼 塔 宫 庙 校", "上楼"),
    Rule("room", "room kitchen bedroom hall attic cellar", "室 厅 房", "同房"),
    Rule("nature", "river forest mountain lake sea island desert", "山 河 湖 海 林 岛"),
    Rule("food", "bread rice soup meat apple cheese salt", "饭 面 汤 饼 糕 肉", "表面 地面 对面 方面 见面"),
    Rule("drink", "water tea coffee wine beer milk juice 茶 咖啡 酒 牛奶 果汁"),
    Rule("vehicle", "car train ship cart bicycle wagon", "车 船 舰 飞机", "停车"),
    Rule("furniture", "table chair bed sofa shelf lamp", "桌 椅 床 柜 沙发", "起床"),
    Rule("container", "box bottle cup bowl basket barrel", "盒 瓶 杯 碗 箱 袋", "干杯"),
    Rule("relation", "friend enemy lover neighbor rival 朋友 敌人 邻居 同伴"),
    Rule("color", "red blue green black white yellow 红色 蓝色 绿色 黑色 白色"),
    Rule("emotion", "anger joy fear love hate shame 愤怒 快乐 恐惧 悲伤"),
    Rule("animal", "dog cat horse bird wolf fish 猫 狗 马 狼", "鸟 鱼", "钓鱼"),
    Rule("material", "wood stone iron glass silk leather 木头 玻璃", "布 铁", "公布 发布"),
    Rule("jewelry", "ring necklace crown bracelet pearl", "戒指 项链 耳环", "", 2),
    Rule("texture", "soft rough smooth sharp 柔软 粗糙 光滑"),
    Rule("festival", "christmas easter birthday 春节 中秋", "节", "关节 细节 季节 情节"),
    Rule("weather", "rain snow wind storm fog 雨 雪 风 雾"),
    Rule("plant", "tree flower grass rose oak", "花 草 树", "烟花 雪花"),
    Rule("illness", "fever cough cold wound 感冒 发烧", "病 症", "毛病"),
    Rule("myth", "ghost dragon demon angel spirit 龙 妖怪", "鬼 神 仙", "精神 眼神 酒鬼"),
    Rule("martial", "duel fencing 剑法 内力", "拳 掌 功法", "鼓掌 手掌"),
    Rule("desire", "wish dream hope longing 愿望 梦想 渴望"),
    Rule("weapon", "sword gun bow knife spear", "剑 刀 枪 弓 炮", "剪刀"),
    Rule("device", "phone computer camera clock radio", "手机 电脑 相机", "", 2),
    Rule("thought", "idea memory doubt plan 想法 记忆 念头"),
    Rule("sound", "noise echo whisper scream", "声 音", "名声 拼音"),
    Rule("smell", "scent odor perfume stench 香气", "味 香", "趣味 意味"),
    Rule("speech", "", "", ""),
    Rule("document", "letter contract report diary", "合同 报告 文件 通知书", "", 2),
    Rule("media", "book film song newspaper novel", "电影 小说 报纸 歌", "", 2),
    Rule("event", "wedding war meeting feast battle", "会议 婚礼 战争 典礼", "", 2),
    Rule("ethnicity", "roman greek german french", "族 国人", "家族 贵族 种族"),
    Rule("rank", "king queen duke baron general", "爵 级", "年级 超级"),
    Rule("law", "crime trial verdict", "罪 条款 法案", "得罪"),
    Rule("measure", "mile pound inch ton kilometer 公里 公斤 厘米"),
    Rule("number", "one two three four five six seven eight nine ten hundred thousand"),
    Rule("region", "north south border province", "省 区 县 州", "地区 小区", 3),
    Rule("path", "bridge tunnel stairs gate", "桥 隧道 走廊", "", 2),
)
PATTERNS = (
    ("person", r"^(?:mr|mrs|ms|dr|sir|lady)\.? [a-z]+$|^(?:小|老)?[王李张刘陈杨赵黄周吴](?:先生|小姐|女士|老师|总)$"),
    ("time", r"^\d{1,2}:\d{2}$|^[0-9一二三四五六七八九十]+[年月日号点分秒]$"),
    ("brand", r"^[a-z0-9]+ (?:inc|corp|ltd|gmbh)$"),
    ("money", r"^[$€£¥]\d|^\d+[元块]$"),
    ("number", r"^[一二三四五六七八九十百千]+[个只条本]$|^\d+(?:st|nd|rd|th)$"),
    ("speech", r"^.{1,2}[问答说叹喊]?道$|^(?:say|said|says|tell|told|ask|asked)$"),
    ("onomatopoeia", r"^(?:哗哗|砰砰|滴答|轰隆)$|^(?:bang|boom|buzz|splash|click)$"),
)
# What begins a count, before which an ending means no kind.
COUNTED = r"^(?:[一二两三四五六七八九十几半这那每某另整]|\d+)"
_LONGEST = max(len(e) for r in RULES for e in r.endings.split())
PLAIN, GENERIC_CONF = 0.1, 0.3

# The bucket of each kind; all others are `other`.
BUCKETS = {
    "person": "person", "title": "person", "kinship": "person", "occupation": "person", "relation": "person", "ethnicity": "person", "rank": "person",
    "place": "place", "building": "place", "room": "place", "nature": "place", "region": "place", "path": "place", "time": "time", "festival": "time",
    "org": "social", "document": "social", "media": "social", "event": "social", "law": "social", "brand": "social", "myth": "social", "martial": "social",
    "system": "system", "generic": "generic",
}


def tag(kind: str, conf: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(float(conf)).alias("conf"))


def rule_rows(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, str, str, int]]:
    """(kind, how, value, least) of each word, ending and exception."""
    return [(r.kind, how, v, r.least) for r in rules for how, values in (("word", r.words), ("end", r.endings), ("but", r.but)) for v in values.split()]


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), "kind string, how string, value string, least int")


def typed(words: DataFrame, rules: DataFrame | None = None, longest: int = _LONGEST) -> DataFrame:
    """words with `tags`, strongest first: array<struct<kind, conf>>. rules: as `rule_table` has them, with endings of `longest`
    characters at most."""
    spark = words.sparkSession
    rules = rule_table(spark) if rules is None else rules
    word = F.col("word")
    ends = [F.when(F.length("word") >= k, F.struct(F.lit("end").alias("how"), F.right(word, F.lit(k)).alias("value"))) for k in range(1, longest + 1)]
    whole = [F.struct(F.lit(how).alias("how"), word.alias("value")) for how in ("word", "but")]
    met = words.select("word").distinct().select("word", F.inline(F.array_compact(F.array(*whole, *ends)))).join(F.broadcast(rules), ["how", "value"])
    free = ~word.rlike(COUNTED) & ~word.isin(*T.STOP_WORDS) & (F.length("word") >= F.col("least"))
    counts = met.where((F.col("how") != "end") | free)
    formed = words.select("word").distinct().select("word", F.explode(F.array_compact(F.array(*[F.when(word.rlike(p), F.lit(k)) for k, p in PATTERNS]))).alias("kind"))
    hits = counts.select("word", "kind", "how").unionAll(formed.select("word", "kind", F.lit("word").alias("how")))
    # an exception takes the endings of its kind away, but not a word or a form
    kinds = hits.groupBy("word", "kind").agg(F.max(F.col("how") == "word").alias("sure"), F.max(F.col("how") == "but").alias("but")).where("sure or not but")
    conf = spark.createDataFrame(list(CONF.items()), "kind string, conf double")
    order = lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).when(a["kind"] < b["kind"], -1).otherwise(1)
    tags = kinds.join(F.broadcast(conf), "kind").groupBy("word").agg(F.array_sort(F.collect_set(F.struct("kind", "conf")), order).alias("tags"))
    person = F.filter("tags", lambda t: t["kind"] == "person")
    found = F.when(F.size(person) > 0, person).otherwise(F.coalesce("tags", F.array(tag("plain", PLAIN))))
    return words.join(tags, "word", "left").select(*[words[c] for c in words.columns], found.alias("tags"))


def mark_generic(tags: Column, generic: Column) -> Column:
    """Adds the `generic` tag, in place of `plain`."""
    rest = F.filter(tags, lambda t: t["kind"] != "plain")
    sorted_tags = F.array_sort(F.concat(rest, F.array(tag("generic", GENERIC_CONF))), lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).otherwise(0))
    return F.when(generic, sorted_tags).otherwise(tags)


def visible(tags: Column, kinds: list[str]) -> Column:
    """Whether the first kind is shown, and, where a word is generic, generic words are."""
    first = tags[0]["kind"]
    return (first != "system") & first.isin(kinds) & (~F.exists(tags, lambda t: t["kind"] == "generic") | F.lit("generic" in kinds))


def bucket(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(BUCKETS.items()) for x in pair])
    return F.coalesce(table[kind], F.lit("other"))


def block(words: DataFrame, baseline: list[str], listed: DataFrame) -> DataFrame:
    """words with `reason`: 'baseline' (silent: equal to a baseline word or, from four letters on, holding one), the reason of
    the list (word, reason), or null for words that stay. The baseline is a fixed list, so it is part of the expression."""
    held = F.col("word").isin(baseline)
    for part in (b for b in baseline if len(b) >= 4):
        held = held | F.col("word").contains(part)
    joined = words.join(listed, "word", "left")
    return joined.select(*words.columns, F.when(held, "baseline").otherwise(F.col("reason")).alias("reason"))


def refile(words: DataFrame, kinds: DataFrame, shown: list[str], most: int) -> DataFrame:
    """word, n, kind and the user's kinds (word, kind) -> the words whose kind is shown after that, most frequent first."""
    moved = words.join(kinds.select("word", F.col("kind").alias("new")), "word", "left")
    return moved.select("word", "n", F.coalesce("new", "kind").alias("kind")).where(F.col("kind").isin(shown)).orderBy(F.desc("n"), "word").limit(most)
