"""Mixing sources to target weights.

Sizes are added up for each source, each source gets a target share of all words, and a document is emitted
floor(rate) times plus one more time by a hash-seeded coin with the fraction as its probability, where rate is its
source's target over its source's size.

Targets. Sources stand in code-point order, null last, and weigh 5, 2, 1, repeating. A target never exceeds `cap` times
the source's size; what is above is dealt again by weight until none is above. That ends at min(cap * size, x * weight)
for one level x, which a running sum over the sources in order of cap * size / weight finds at once.

Coins. A coin is the first 32 bits of md5(seed:doc_id). Each of `seeds` seeds is tried in the same aggregation, and each
source uses the one that takes it closest to its target, so a source of few, uneven documents comes near it as well.
A row without doc_id has the md5 of its text, after a colon, in place of the doc_id.

Only one row for each source and seed is shuffled, whatever share of the rows one source holds. The table of sources is
written first, so that Spark knows its size when it is joined back: below the threshold it is broadcast, and no text moves.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own; repeated
rows each count, and share their coin; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, stored, table, whole_text

SEEDS = 32
CAP = 3
# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def coin(seed: Column, key: Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the key alone."""
    digest = F.md5(F.concat(seed, F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size -> the same with `target`. One row for each source comes in, a bounded dimension."""
    n = len(WEIGHTS)
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.coalesce(*[F.when(place % n == k, F.lit(w)) for k, w in enumerate(WEIGHTS)])
    weighed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = level.withColumn("x", (F.col("all_size") - F.col("most_before")) / F.col("weight_left"))
    fits = F.when(F.col("x") <= F.col("most") / F.col("weight"), F.col("x"))
    return level.withColumn("level", F.max(fits).over(every)).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")).alias("target"),
    )


def sized(docs: DataFrame) -> DataFrame:
    """docs with size and with text_key, which stands in for a null doc_id and is null otherwise."""
    text_key = F.when(F.col("doc_id").isNull(), F.concat(F.lit(":"), F.md5(whole_text())))
    return docs.withColumn("size", F.regexp_count(whole_text(), F.lit(WORD)).cast("long")).withColumn("text_key", text_key)


def coin_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.col("text_key"))


def plan(narrow: DataFrame, seeds: int = SEEDS, cap: int = CAP) -> DataFrame:
    """source, doc_id, text_key, size -> for each source: goal_source, source_size, target, whole, part, seed."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = goal.select(F.col("source").alias("goal_source"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    tossed = narrow.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    taken = [F.sum(F.col("size") * (F.col("whole") + (coin(F.lit(str(s)), coin_key()) < F.col("part")).cast("long"))) for s in range(seeds)]
    tried = tossed.groupBy("goal_source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "part")], *[t.alias(f"t{s}") for s, t in enumerate(taken)]
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))
    return tried.select("goal_source", "source_size", "target", "whole", "part", best["seed"].alias("seed"))


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs as `sized` gives them -> every row with source_size, target, copies and taken."""
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col("goal_source")), "left")
    copies = (F.col("whole") + (coin(F.col("seed").cast("string"), coin_key()) < F.col("part")).cast("long")).cast("long")
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("goal_source", "whole", "part", "seed", "text_key")


def mix(docs: DataFrame, seeds: int = SEEDS, cap: int = CAP) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken."""
    narrow = stored(sized(docs).select("source", "doc_id", "text_key", "size"), "sizes")
    return apply_plan(sized(docs), stored(plan(narrow, seeds, cap), "plan"))


def mixed_rows(docs: DataFrame, seeds: int = SEEDS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    taken = mix(packed, seeds, cap).where("copies > 0 and size > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = stored(sized(table(spark, sf_dir, "documents")).select("source", "doc_id", "text_key", "size"), "sizes")
    return apply_plan(narrow, stored(plan(narrow), "plan")).select("doc_id", "size", "source_size", "target", "taken")


def sql(docs: str = "documents", seeds: int = SEEDS, cap: int = CAP) -> str:
    """The rows of op6 in DuckDB."""
    weight = " ".join(f"when {k} then {w}" for k, w in enumerate(WEIGHTS))
    return f"""with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from {docs}),
    sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
    weighed as (select *, case (row_number() over (order by source is null, source) - 1) % {len(WEIGHTS)} {weight} end as weight, source_size * {cap} as most from sizes),
    ranked as (select *, cast(sum(source_size) over () as bigint) as all_size,
        cast(coalesce(sum(most) over (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as bigint) as most_before,
        cast(sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as bigint) as weight_left from weighed),
    levels as (select *, (all_size - most_before) / weight_left as x from ranked),
    goal as (select source, source_size, coalesce(least(cast(most as double), max(case when x <= most / weight then x end) over () * weight), cast(most as double)) as target from levels),
    rates as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from goal),
    parts as (select *, cast(floor(rate) as bigint) as whole, rate - floor(rate) as part from rates),
    seeds as (select unnest(range({seeds})) as seed),
    tried as (select p.source, s.seed, abs(cast(sum(d.size * (p.whole + case when cast(('0x' || substr(md5(s.seed || ':' || d.doc_id), 1, 8)) as bigint) / 4294967296.0 < p.part then 1 else 0 end)) as bigint) - any_value(p.target)) as off
        from sized d join parts p on d.source is not distinct from p.source cross join seeds s group by p.source, s.seed),
    chosen as (select source, arg_min(seed, (off, seed)) as seed from tried group by source)
    select d.doc_id, d.size, p.source_size, p.target,
        d.size * (p.whole + case when cast(('0x' || substr(md5(c.seed || ':' || d.doc_id), 1, 8)) as bigint) / 4294967296.0 < p.part then 1 else 0 end) as taken
    from sized d join parts p on d.source is not distinct from p.source join chosen c on d.source is not distinct from c.source"""
