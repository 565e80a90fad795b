"""Rankings of equivalent spellings, and what users override, over all words of the documents.

Spellings are ranked for a stated set of targets, the TARGETS most frequent words, against every word: the targets are the
small side of each join, and no pair of two other words is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import aliases as A
from parley.operators import overrides as O
from parley.operators import packs
from parley.plans.words import SQL_ACCEPT, sql_tokens
from parley.session import cut, table

TARGETS = 20
# Weights of the signals of an equivalent spelling, and the least spelling similarity that counts.
CONTAIN, CONTAIN_RATIO, SPELLING, PREFIX, LENGTH = 4.0, 2.0, 6.0, 2.0, 0.5
SPELLING_MIN = 0.6
SHOWN = 8
#: Pairs of letters that sound like one, and the class of each consonant by where it is made: lips, teeth, tongue, throat.
SOUNDS = (("ph", "f"), ("gh", "k"), ("ck", "k"), ("qu", "k"), ("sh", "s"), ("ch", "s"), ("th", "t"))
CONSONANTS, CLASSES = "bpfvwdtszxjgkqcmnlrh", "ppfffttsssskkkkmnllh"


def counted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n: all acceptable words of the documents."""
    return T.counted(table(spark, sf_dir, "documents"))


def targets(words: DataFrame, most: int = TARGETS) -> DataFrame:
    return words.orderBy(F.desc("n"), "word").limit(most)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def latin(word: Column) -> Column:
    """Words whose spelling can be compared: lower-case Latin of three letters or more."""
    return word.rlike(r"^[a-z][a-z'. -]{2,}$")


def affix_score(a: Column, b: Column) -> Column:
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    held = (F.length(short) >= 2) & (short != long) & long.contains(short)
    subsequence = T.has_han(short) & T.has_han(long) & (F.length(short) >= 2) & F.rlike(long, F.concat_ws(".*", F.split(short, "")))
    return F.when(held, CONTAIN + CONTAIN_RATIO * F.length(short) / F.length(long)).when(subsequence & (short != long), 3.0).otherwise(0.0)


def latin_skeleton(word: Column) -> Column:
    """Consonant classes of a Latin word; vowels and neighbours of one class do not count."""
    sounds = F.lower(word)
    for letters, sound in SOUNDS:
        sounds = F.replace(sounds, F.lit(letters), F.lit(sound))
    sounds = F.translate(F.regexp_replace(F.regexp_replace(sounds, "c([eiy])", "s$1"), "[^a-z]|[aeiouy]", ""), CONSONANTS, CLASSES)
    return F.regexp_replace(sounds, r"(.)\1+", "$1")


def _pairs(spark, sf_dir):
    """Every word with each target, and whether both are Latin, which is tested once for each word."""
    words = counted_words(spark, sf_dir).withColumn("latin", latin(F.col("word")))
    of = targets(words).select(F.col("word").alias("target"), F.col("latin").alias("target_latin"))
    return words.join(F.broadcast(of), F.col("word") != F.col("target")).withColumn("latin", F.col("latin") & F.col("target_latin")).drop("target_latin")


def spelled_alike() -> Column:
    """The spelling similarity where it counts, else null. Lengths rule most pairs out before any distance is taken."""
    longest = F.greatest(F.length("word"), F.length("target"))
    near = F.col("latin") & (F.abs(F.length("word") - F.length("target")) <= longest * (1 - SPELLING_MIN) + 1e-9)
    value = F.when(near, edit_similarity(F.col("word"), F.col("target")))
    return F.when(value >= SPELLING_MIN, value)


def alias_edit_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("target", "word", F.round(spelled_alike(), 6).alias("similarity")).where("similarity is not null")


def alias_affix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("target", "word", F.round(affix_score(F.col("word"), F.col("target")), 6).alias("score")).where("score > 0")


def skeletons(spark, sf_dir):
    return counted_words(spark, sf_dir).select("word", latin_skeleton(F.col("word")).alias("skeleton"))


def alias_rank(spark, sf_dir):
    """The best candidates for each target."""
    counts = F.coalesce(spelled_alike() * SPELLING, F.lit(0.0))
    near = F.when(F.abs(F.length("word") - F.length("target")) <= 1, LENGTH).otherwise(0.0)
    begins = F.when(F.col("word").startswith(F.left("target", F.lit(2))), PREFIX).otherwise(0.0)
    scored = _pairs(spark, sf_dir).withColumn("score", F.round(affix_score(F.col("word"), F.col("target")) + counts + near + begins, 6))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), F.desc("n"), "word"))  # cut within each task first
    return scored.withColumn("place", place).where(F.col("place") <= SHOWN).select("target", "word", "score", "place")


# Han forms of the documents' words, letter by letter, and the class of each character by its initial.
SPOKEN, WRITTEN = "bcdfghjklmnpqrstvwxz", "巴凯德弗戈哈杰肯莉玛娜佩奎瑞萨托维沃克泽"
HAN_SOUNDS = {"": "阿艾", "p": "巴佩", "k": "凯戈杰肯奎克", "t": "德托", "f": "弗维沃", "h": "哈", "l": "莉瑞", "m": "玛", "n": "娜", "s": "萨泽"}


def _two_scripts(spark, sf_dir):
    """All Latin words, and every third one in Han characters as well."""
    words = cut(counted_words(spark, sf_dir)).where(F.col("word").rlike("^[a-z]+$"))
    han = words.where(F.col("n") % 3 == 0).groupBy(F.translate(F.regexp_replace("word", "[aeiouy]", "阿"), SPOKEN, WRITTEN).alias("word")).agg(F.sum("n").alias("n"))
    return words.select("word", "n", F.lit("latin").alias("side"), latin_skeleton(F.col("word")).alias("skeleton")).unionAll(
        han.select("word", "n", F.lit("han"), A.han_skeleton(F.col("word"), HAN_SOUNDS))
    )


def skeleton_pairs(spark, sf_dir):
    """All pairs of skeletons of the two scripts that are alike."""
    words = cut(_two_scripts(spark, sf_dir))
    return A.alike(words.where("side = 'han'"), words.where("side = 'latin'"))


def alias_suggest(spark, sf_dir):
    """The suggestion of each word; words of one count from 50 up are of one group."""
    words = cut(_two_scripts(spark, sf_dir))
    groups = words.where("n >= 50").select("word", F.concat_ws(" ", F.lit("group"), F.col("n").cast("string")).alias("group"))
    return A.suggestions(words, groups)


def pack_rules(spark, sf_dir):
    """Rules of sessions after packs were found, moved, applied, overruled and, for some, taken back. Orders are the changes."""
    rows = table(spark, sf_dir, "orders")
    name, kind = F.concat(F.lit("card "), (F.col("o_custkey") % 50).cast("string")), F.when(F.col("o_orderstatus") == "F", "stop").otherwise("override")
    value = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    log = lambda part, owner, later: rows.where(F.col("o_orderkey") % 3 == part).select(owner.alias("owner"), (F.col("o_orderkey") + later).alias("version"), F.lit("set").alias("action"), kind.alias("kind"), F.concat(F.lit("key "), (F.col("o_orderkey") % 37).cast("string")).alias("key"), value.alias("value"))
    known, cards = log(0, F.when(F.col("o_custkey") % 4 == 1, F.concat(name, F.lit(" whole"))).otherwise(name), 0), rows.select((F.col("o_custkey") % 50).alias("k")).distinct()
    card = F.concat(F.lit("card "), F.col("k").cast("string"))
    cards = cards.select(F.concat(F.lit("session "), F.col("k").cast("string")).alias("session"), F.when(F.col("k") % 5 != 0, F.concat(card, F.lit(" whole"))).alias("strong"), card.alias("weak"))
    session = F.concat(F.lit("session "), (F.col("o_custkey") % 50).cast("string"))
    found = packs.resolved(known, cards)
    known = known.unionAll(packs.migration(known, found, APPLIED))
    before = log(1, session, 0)
    after = before.unionAll(packs.application(before, known, found, APPLIED)).unionAll(log(2, session, APPLIED))
    taken_back = cards.where("session like '%7'").select(F.col("session").alias("owner"))
    return packs.rules(after.unionAll(packs.undo(taken_back, APPLIED, 2 * APPLIED)))


APPLIED = 1_000_000_000
PRIORITY_LINE = "the; Zebra;of ； the ;; Quartz ;idiot"
ALIASES = (("the", "of"), ("of", "and"), ("is", "was"), ("was", "is"), ("for", "for"), ("with", "that"), ("that", "nowhere"), ("it", "and"))


def _priority(spark):
    line = spark.createDataFrame([(PRIORITY_LINE,)], "line string")
    return line.select(F.posexplode(O.parse_priority(F.col("line"))).alias("place", "item"))


def _all_words(spark, sf_dir):
    return T.counted(table(spark, sf_dir, "documents"), every=True)


def priority_apply(spark, sf_dir):
    out = O.apply_priority(_all_words(spark, sf_dir), _priority(spark))
    return out.withColumn("n", F.round("n", 6))


def alias_closure(spark, sf_dir):
    """Each word as an alias of the word without its last letter, or, in -e, of the one with an s more, where the documents have it:
    chains of many steps, and a cycle for each such pair."""
    words = counted_words(spark, sf_dir).where(F.col("word").rlike("^[a-z]{3,}$")).select("word")
    target = F.when(F.col("word").endswith("e"), F.concat("word", F.lit("s"))).otherwise(F.left("word", F.length("word") - 1))
    pairs = words.select(F.col("word").alias("source"), target.alias("target")).join(words.withColumnRenamed("word", "target"), "target", "left_semi")
    return O.alias_closure(pairs.select("source", "target"))


def overrides_apply(spark, sf_dir):
    return O.apply_aliases(_all_words(spark, sf_dir), spark.createDataFrame(ALIASES, "source string, target string"))


_TOP = f"""t as ({sql_tokens("documents", "doc_id")}), w as materialized (select word, count(*) as n from t where {SQL_ACCEPT} group by 1),
    g as materialized (select word as target from w order by n desc, word limit {TARGETS}), p as (select word, n, target from w join g on word != target)"""
_ALL = f"""t as ({sql_tokens("documents", "doc_id")}), w as materialized (select word, count(*) as n from t group by 1)"""
_SOUNDS = "lower(word)"
for _letters, _sound in SOUNDS:
    _SOUNDS = f"replace({_SOUNDS}, '{_letters}', '{_sound}')"
_SOUNDS = f"translate(regexp_replace(regexp_replace({_SOUNDS}, 'c([eiy])', 's\\1', 'g'), '[^a-z]|[aeiouy]', '', 'g'), '{CONSONANTS}', '{CLASSES}')"
for _class in sorted(set(CLASSES)):
    _SOUNDS = f"regexp_replace({_SOUNDS}, '{_class}+', '{_class}', 'g')"
_EDIT = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})))"
_LATIN = "regexp_full_match({}, '[a-z][a-z''. -]{{2,}}')"
_AFFIX = f"""case when least(length({{0}}), length({{1}})) >= 2 and {{0}} != {{1}} and (contains({{0}}, {{1}}) or contains({{1}}, {{0}}))
    then {CONTAIN} + {CONTAIN_RATIO} * least(length({{0}}), length({{1}})) / greatest(length({{0}}), length({{1}})) else 0.0 end"""
_ALIASES = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") a(source, target)"
_CHAIN = f"""chain as (select source, target as final, [source, target] as path from {_ALIASES} where source != target union all
        select c.source, a.target, list_append(path, a.target) from chain c join {_ALIASES} on a.source = c.final where not list_contains(path, a.target)),
    ends as (select source, final from chain where final not in (select source from {_ALIASES}))"""

_CLASSES = "regexp_replace(word, '[阿艾]', '', 'g')"
for _class, _characters in HAN_SOUNDS.items():
    if _class:
        _CLASSES = f"regexp_replace({_CLASSES}, '[{_characters}]+', '{_class}', 'g')"
_SCRIPTS = f"""{_TOP}, lw as materialized (select word, n from w where regexp_full_match(word, '[a-z]+')),
    hw as (select translate(regexp_replace(word, '[aeiouy]', '阿', 'g'), '{SPOKEN}', '{WRITTEN}') as word, cast(sum(n) as bigint) as n from lw where n % 3 = 0 group by 1),
    ws as materialized (select word, n, 'latin' as side, {_SOUNDS} as skeleton from lw union all select word, n, 'han', {_CLASSES} from hw),
    sk as materialized (select distinct side, skeleton from ws where length(skeleton) >= 2),
    close as materialized (select a.skeleton as a, b.skeleton as b from sk a join sk b on a.side = 'han' and b.side = 'latin' and abs(length(a.skeleton) - length(b.skeleton)) <= 0.5 * greatest(length(a.skeleton), length(b.skeleton))),
    near as materialized (select a, b, round(s, 6) as similarity from (select a, b, {_EDIT.format("a", "b")} as s from close) where s >= {A.SIMILAR})"""
_RULES = lambda log: f"""(select owner, kind, key, arg_max({{'v': value}}, version).v as value, max(case when action = 'apply' then version end) as applied from {log} l where action != 'undo' and not exists (select 1 from {log} a join {log} u on u.action = 'undo' and a.action = 'apply' and u.owner = a.owner and cast(u.value as bigint) = a.version where a.owner = l.owner and a.kind = l.kind and a.key = l.key) group by 1, 2, 3 having arg_max({{'v': value}}, version).v is not null)"""
_CHANGES = lambda part, owner, later: f"select {owner} as owner, o_orderkey + {later} as version, 'set' as action, case when o_orderstatus = 'F' then 'stop' else 'override' end as kind, 'key ' || (o_orderkey % 37) as key, case when o_orderkey % 11 != 0 then o_orderpriority end as value from orders where o_orderkey % 3 = {part}"

QUERIES = {
    "alias_edit_similarity": alias_edit_similarity, "alias_affix": alias_affix, "latin_skeleton": skeletons, "alias_rank": alias_rank,
    "skeleton_pairs": skeleton_pairs, "alias_suggest": alias_suggest, "pack_rules": pack_rules, "priority_apply": priority_apply, "alias_closure": alias_closure, "overrides_apply": overrides_apply,
}
ORACLES = {
    "alias_edit_similarity": f"""with {_TOP}, q as materialized (select target, word from p where abs(length(word) - length(target)) <= 0.5 * greatest(length(word), length(target)) and {_LATIN.format('word')} and {_LATIN.format('target')}),
        s as materialized (select target, word, round({_EDIT.format('word', 'target')}, 6) as similarity from q) select * from s where similarity >= {SPELLING_MIN}""",
    "alias_affix": f"with {_TOP} select target, word, round({_AFFIX.format('word', 'target')}, 6) as score from p where {_AFFIX.format('word', 'target')} > 0",
    "latin_skeleton": f"with {_TOP} select word, {_SOUNDS} as skeleton from w",
    "alias_rank": f"""with {_TOP},
        s as (select target, word, n, round({_AFFIX.format('word', 'target')} + case when {_LATIN.format('word')} and {_LATIN.format('target')} and {_EDIT.format('word', 'target')} >= {SPELLING_MIN} then {_EDIT.format('word', 'target')} * {SPELLING} else 0.0 end
            + case when abs(length(word) - length(target)) <= 1 then {LENGTH} else 0.0 end + case when starts_with(word, left(target, 2)) then {PREFIX} else 0.0 end, 6) as score from p),
        r as (select *, cast(row_number() over (partition by target order by score desc, n desc, word) as int) as place from s) select target, word, score, place from r where place <= {SHOWN}""",
    "skeleton_pairs": f"with {_SCRIPTS} select * from near",
    "alias_suggest": f"""with {_SCRIPTS}, best as (select side, skeleton, min({{'n': -n, 'word': word}}) as top from ws where length(skeleton) >= 2 group by 1, 2),
        r as (select 'han' as side, a as skeleton, -{A.SOUND} * similarity as score, top from near join best on best.side = 'latin' and best.skeleton = b union all select 'latin', b, -{A.SOUND} * similarity, top from near join best on best.side = 'han' and best.skeleton = a),
        one as (select side, skeleton, min({{'score': score, 'top': top}}) as found from r group by 1, 2), told as (select word, found from ws join one using (side, skeleton)),
        gg as (select *, n as grp from ws where n >= 50), m as (select x.word, x.side != y.side and length(x.skeleton) >= 2 and length(y.skeleton) >= 2 as cross_, {_EDIT.format("x.skeleton", "y.skeleton")} as s, y.n as yn, y.word as yw from gg x join gg y on x.grp = y.grp and x.word != y.word),
        every as (select word, found from told union all select word, {{'score': -({A.TOGETHER} + case when cross_ and s >= {A.SIMILAR} then {A.SOUND} * round(s, 6) else 0.0 end), 'top': {{'n': -yn, 'word': yw}}}} from m)
        select word, min(found).top.word as suggested, round(-min(found).score, 6) as score from every group by word having -min(found).score > {A.ENOUGH}""",
    "pack_rules": f"""with known as ({_CHANGES(0, "'card ' || (o_custkey % 50) || case when o_custkey % 4 = 1 then ' whole' else '' end", 0)}), kr as {_RULES("known")},
        cards as (select distinct 'session ' || (o_custkey % 50) as session, case when (o_custkey % 50) % 5 != 0 then 'card ' || (o_custkey % 50) || ' whole' end as strong, 'card ' || (o_custkey % 50) as weak from orders),
        found as (select *, coalesce(strong, weak) as fp, case when strong in (select owner from kr) then 'strong' when weak in (select owner from kr) then 'weak' else 'none' end as via from cards),
        full_ as (select owner, kind, key, value from kr union all select strong, kind, key, value from kr join (select distinct strong, weak from found where via = 'weak' and strong is not null) on owner = weak),
        before as ({_CHANGES(1, "'session ' || (o_custkey % 50)", 0)}), br as {_RULES("before")},
        ap as (select session as owner, {APPLIED} as version, 'apply' as action, kind, key, value from full_ f join found on fp = owner and via != 'none' where not exists (select 1 from br where br.owner = session and br.kind = f.kind and br.key = f.key)),
        after_ as (select * from before union all select * from ap union all {_CHANGES(2, "'session ' || (o_custkey % 50)", APPLIED)} union all select session, {2 * APPLIED}, 'undo', null, null, '{APPLIED}' from cards where session like '%7')
        select * from {_RULES("after_")}""",
    "priority_apply": f"""with {_ALL}, p as (select * from (values ('the', 0), ('Zebra', 1), ('of', 2), ('Quartz', 3), ('idiot', 4)) p(item, place)), m as (select max(n) as most from w),
        s as (select item, most * (1 + (5 - place) / 5) as value from p cross join m)
        select coalesce(word, item) as word, round(coalesce(value, cast(n as double)), 6) as n, value is not null as priority from w full join s on lower(word) = lower(item)""",
    "alias_closure": f"""with recursive {_TOP}, v as materialized (select word from w where regexp_full_match(word, '[a-z]{{3,}}')),
        a as materialized (select word as source, case when word like '%e' then word || 's' else left(word, length(word) - 1) end as target from v where case when word like '%e' then word || 's' else left(word, length(word) - 1) end in (select word from v)),
        chain as (select source, target as final, [source, target] as path from a union all select c.source, a.target, list_append(path, a.target) from chain c join a on a.source = c.final where not list_contains(path, a.target))
        select source, final from chain where final not in (select source from a)""",
    "overrides_apply": f"""with recursive {_ALL}, {_CHAIN}, e as (select * from ends where final in (select word from w)), k as (select w.*, e.final from w left join e on e.source = w.word),
        s as (select coalesce(final, word) as word, cast(sum(n) as bigint) as n from k group by 1) select s.word, s.n from s join k on k.word = s.word where k.final is null""",
}
