"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Two documents are linked if the sets of their 5-word shingles (words as they stand; fewer than five words are one
shingle) have a Jaccard similarity of AT or more.

Classes. Documents with equal texts are one class; only its least doc_id, the representative, goes on.

Candidates. Each representative has BANDS * ROWS MinHash values. Representatives that agree on all values of a band share a
bucket, and are candidates of each other; a pair at the threshold shares none with a probability of (1 - AT**ROWS)**BANDS,
1e-7. Buckets of one member are dropped.

Cells. So that a text moves once or twice and not once for each bucket, each representative gets a cell: the least member
that most of its buckets have as their least one. Wherever two cells meet in a bucket, the members in it are sent to the pair of
cells, so each two candidates meet exactly once, in the pair of their cells. Nothing is closed over chains of candidates,
so weak ties do not grow into large groups. (A bucket in which more than CELLS cells meet makes them one.)

Pruning and verification. The sides of a pair of cells are cut into blocks of at most BLOCK members and BLOCK_BYTES of text
by hash, and each pair of blocks is one group of rows in one task, so cells of any size are spread. In it, pairs that share
a bucket are compared MinHash value by MinHash value, STEP at a time: with m agreements of n, the posterior probability that
the similarity reaches AT is the upper tail of a beta distribution (from a uniform prior), and the pair is dropped where that
is below TOLERANCE. What is left is verified by its exact Jaccard similarity, many pairs at once by a product of bit rows.
Rows that leave are links counted for each member and ties to a spanning forest: as many as members, never pairs.

Groups. Ties connect representatives; the least doc_id of a group of linked classes is its class_id.

Hot keys. Where rows meet facts of their key, the facts of keys that hold a SHARE-th of the rows or more, of which there are
SHARE at most, are broadcast, and only the rest is dealt by key; where they meet the least row of their key, they are salted.

Defined results: null and empty texts are of one class and linked to no other; rows that repeat a doc_id count once in
`join`, by the text with the least digest; a row without doc_id takes part under a number from 2**62 up that its text gives it
(rows with equal texts share it), greater than any doc_id: its doc_id stays null, and its class_id is such a number only
where no row with a doc_id is in its group; `deduplicated` keeps one row of each group, whatever repeats; an empty table
gives no rows; other columns are ignored by `join` and pass through `deduplicated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import discard, release, stored, table, whole_text, with_least
from parley.llm.words import WORD_BASE, Words, mixed, signed, slices, span_hashes, utf8, windows

SHINGLE = 5
AT = 0.8
BANDS, ROWS = 40, 5
STEP = 20
TOLERANCE = 1e-9
BLOCK, BLOCK_BYTES = 512, 1 << 20
SLICE = 1 << 20  # bytes of text whose shingles a task holds at once
CELLS = 8
SHARE = 1000
UNNAMED = 1 << 62
SLOTS = 1 << 19

_HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240601)
_MULTIPLY = _rng.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _HASHES, dtype=np.uint64)


def shingles(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h = words.hashes()
    digest, first = windows(h, words.word_at, SHINGLE)
    at = np.searchsorted(first, words.word_at)
    whole = span_hashes(h, words.word_at[:-1], words.word_at[1:], WORD_BASE)
    out = []
    for k, n in enumerate(words.count.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(digest[at[k] : at[k + 1]]))
        elif n:
            out.append(whole[k : k + 1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingle: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 32 bits each."""
    least = np.full(_HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(shingle), 4096):
        least = np.minimum(least, (shingle[k : k + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of each row of MinHash values."""
    v = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
    return out


@lru_cache(maxsize=1)
def least_agreements() -> np.ndarray:
    """For each n, the least number of agreements with which a pair is still not dropped after n MinHash values."""
    out = np.zeros(_HASHES + 1, np.int64)
    for n in range(1, _HASHES + 1):
        # P(J >= AT | m of n agree), J ~ Beta(m + 1, n - m + 1), is the chance of at most m successes in n + 1 trials of AT
        log_term = [math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(AT) + (n + 1 - j) * math.log(1 - AT) for j in range(n + 2)]
        tail = np.cumsum(np.exp(log_term))
        out[n] = int(np.searchsorted(tail, TOLERANCE))
    return out


def node() -> Column:
    """The doc_id, or what stands in for it."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(whole_text()), F.lit(UNNAMED >> 1)))


def signatures(docs: DataFrame) -> DataFrame:
    """node, size (bytes of text), buckets: the bucket of each band, for each document that has any shingle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, most=SLICE):
                full = np.flatnonzero(words.count)
                if not len(full):
                    continue
                sets = shingles(words)
                keys = bands(np.stack([minhash(sets[k]) for k in full]))
                nodes = np.asarray(part.column(part.schema.get_field_index("node")))[full]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.diff(words.text_at)[full]), lists], names=["node", "size", "buckets"])

    return docs.select("node", "text").mapInArrow(rows, "node long, size long, buckets array<long>")


def met(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined to facts, which have one row for each key with `n`, the number of rows that have it (`total` in all).

    At most SHARE keys have total / SHARE rows or more. Their hashes, which the driver collects, part rows and facts alike: what
    has the hash of a hot key meets by a broadcast, and only the rest is dealt by key, so no hot key is dealt to one task and no
    row passes a join that only tells hot keys from others. With how = "left", keys without facts must not be hot.
    """
    key = F.xxhash64(*keys)
    hot = [r[0] for r in facts.where(F.col("n") * SHARE >= max(1, total)).select(key).distinct().collect()]
    if not hot:
        return rows.join(facts, keys, how)
    few = rows.where(key.isin(hot)).join(F.broadcast(facts.where(key.isin(hot))), keys, how)
    return few.unionByName(rows.where(~key.isin(hot)).join(facts.where(~key.isin(hot)), keys, how))


def components(ties: DataFrame) -> DataFrame:
    """a, b (a tie each) -> node, root: the least node that each node is connected with.

    Alternates two steps until nothing changes: every node's greater neighbours are tied to its least neighbour, then
    every node and its smaller neighbours to the least of these. Each step is one grouping and one join, and the
    number of steps grows with the logarithm of the longest chain.
    """
    edges = stored(ties.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "ties")
    print_of = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    state = edges.select(*print_of).first()
    while state["n"]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = with_least(large, "u", "v", "m")
        tied = small.select("u", F.col("m").alias("v")).unionAll(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        was, before = edges, state
        edges = stored(tied.where("u != v").distinct(), "ties")
        discard(was)
        state = edges.select(*print_of).first()
        if state == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


class Block:
    """Members of a component with their shingles and MinHash values."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        words = Words(*utf8(pa.array(texts, pa.large_string())))
        self.ids, self.sets = ids, shingles(words)
        self.values = np.stack([minhash(x) for x in self.sets]) if len(ids) else np.zeros((0, _HASHES), np.uint32)
        self.keys = bands(self.values) if len(ids) else np.zeros((0, BANDS), np.uint64)


def pruned(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that share a bucket and outlive the comparison of their MinHash values."""
    shared = np.zeros(len(i), bool)
    for k in range(BANDS):
        shared |= a.keys[i, k] == b.keys[j, k]
    i, j = i[shared], j[shared]
    agree, floor = np.zeros(len(i), np.int64), least_agreements()
    for n in range(STEP, _HASHES + 1, STEP):
        agree += (a.values[i, n - STEP : n] == b.values[j, n - STEP : n]).sum(axis=1)
        alive = agree >= floor[n]
        i, j, agree = i[alive], j[alive], agree[alive]
    return i, j


def linked(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with a similarity of AT or more, exactly."""
    out_i, out_j = [], []
    every = np.arange(len(b.ids))
    tall = max(1, (1 << 18) // max(1, len(every)))
    for k in range(0, len(a.ids), tall):  # candidate pairs a few rows at a time
        i, j = np.repeat(np.arange(k, min(k + tall, len(a.ids))), len(every)), np.tile(every, min(tall, len(a.ids) - k))
        if same:
            i, j = i[i < j], j[i < j]
        i, j = pruned(a, b, i, j)
        out_i.append(i)
        out_j.append(j)
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(x) for x in a.sets]), np.array([len(x) for x in b.sets])
    both = common(a.sets, b.sets, i, j)
    similar = both * 10 >= (size_a[i] + size_b[j] - both) * round(AT * 10)
    return i[similar], j[similar]


def common(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair has in common: few pairs one by one, many by a product of bit rows."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    rows, cols = np.unique(i), np.unique(j)
    total = np.zeros((len(rows), len(cols)), np.float32)
    flat = np.concatenate([left[x] for x in rows])
    row = np.repeat(np.arange(len(rows)), [len(left[x]) for x in rows])
    flat_b = np.concatenate([right[y] for y in cols])
    col = np.repeat(np.arange(len(cols)), [len(right[y]) for y in cols])
    vocabulary = np.intersect1d(flat, flat_b)
    place, place_b = np.searchsorted(vocabulary, flat), np.searchsorted(vocabulary, flat_b)
    known = place < len(vocabulary)
    known[known] = vocabulary[place[known]] == flat[known]
    known_b = place_b < len(vocabulary)
    known_b[known_b] = vocabulary[place_b[known_b]] == flat_b[known_b]
    row, place, col, place_b = row[known], place[known], col[known_b], place_b[known_b]
    wide = 8192
    order, order_b = np.argsort(place, kind="stable"), np.argsort(place_b, kind="stable")
    row, place, col, place_b = row[order], place[order], col[order_b], place_b[order_b]
    for k in range(0, len(vocabulary), wide):
        x, y = np.zeros((len(rows), wide), np.float32), np.zeros((len(cols), wide), np.float32)
        s, e = np.searchsorted(place, [k, k + wide])
        x[row[s:e], place[s:e] - k] = 1
        s, e = np.searchsorted(place_b, [k, k + wide])
        y[col[s:e], place_b[s:e] - k] = 1
        total += x @ y.T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def links_of_group(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of one pair of blocks -> node, tied (the least member it is tied to here), n (its links here)."""
    same = group["left"].iloc[0] == group["right"].iloc[0] and group["i"].iloc[0] == group["j"].iloc[0]
    group = group.drop_duplicates(["node", "side"])  # rows that repeat
    sides = [group[group["side"] == k].sort_values("node") for k in (0, 1)]
    a = Block(sides[0]["node"].to_numpy(), sides[0]["text"].tolist())
    b = a if same else Block(sides[1]["node"].to_numpy(), sides[1]["text"].tolist())
    i, j = linked(a, b, same) if len(a.ids) and len(b.ids) else (np.zeros(0, np.int64),) * 2
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    j = j if same else j + len(a.ids)
    n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = np.arange(len(ids))
    while True:  # least neighbour, until nothing changes
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = n > 0
    return pd.DataFrame({"node": ids[some], "tied": ids[root[some]], "n": n[some]})


def candidates(buckets: DataFrame) -> DataFrame:
    """bucket, node, size -> the same with head, the least member, where a bucket has others, stored."""
    heads = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "heads")
    total = heads.agg(F.sum("n")).first()[0] or 0
    out = stored(met(buckets, heads, ["bucket"], total).select("bucket", "node", "size", "head"), "candidates")
    discard(heads)
    return out


def cells(found: DataFrame, most: int = CELLS) -> DataFrame:
    """bucket, node, size, cell for each candidate (bucket, node, size, head), stored."""
    votes = found.groupBy("node", "head").agg(F.count("*").alias("votes"))
    own = votes.groupBy("node").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("cell"))
    held = stored(found.join(own, "node").select("bucket", "node", "size", "cell"), "cells")
    pairs = held.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    wide = pairs.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cell").alias("least")).where(F.col("n") > most)
    wide = stored(wide, "wide")
    total = wide.agg(F.sum("n")).first()[0]
    if total:
        ties = met(pairs.select("bucket", "cell"), wide, ["bucket"], total).select(F.col("cell").alias("a"), F.col("least").alias("b"))
        roots = stored(components(ties), "roots").withColumnRenamed("node", "cell")
        n_of = stored(held.groupBy("cell").agg(F.count("*").alias("n")).join(roots, "cell", "left"), "sizes")
        n_held = n_of.agg(F.sum("n")).first()[0]
        one = met(held, n_of, ["cell"], n_held)
        was, held = held, stored(one.select("bucket", "node", "size", F.coalesce("root", "cell").alias("cell")), "cells")
        discard(was)
        discard(n_of)
    discard(wide)
    return held


def placed(held: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """node and its places (left, right: a pair of cells; i, j: their blocks; side), stored."""
    in_bucket = held.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    shared = in_bucket.groupBy("bucket").agg(F.sum("n").alias("n"), F.collect_set("cell").alias("meet")).where(F.size("meet") > 1)
    shared = stored(shared, "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    others = met(held, shared, ["bucket"], total).select("node", "size", "cell", F.explode("meet").alias("other")).where("cell != other")
    every = held.select("node", "size", "cell", F.col("cell").alias("other")).unionAll(others).distinct()
    sided = stored(every.select("node", "size", F.least("cell", "other").alias("left"), F.greatest("cell", "other").alias("right"), (F.col("cell") > F.col("other")).cast("int").alias("side")), "sided")
    n_blocks = lambda k: F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == k) / block), F.ceil(F.coalesce(F.sum(F.when(F.col("side") == k, F.col("size"))), F.lit(0)) / block_bytes)).cast("int")
    sizes = sided.groupBy("left", "right").agg(F.count("*").alias("n"), n_blocks(0).alias("rows"), n_blocks(1).alias("columns")).where("n > 1")
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    one_cell = F.col("left") == F.col("right")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("rows")).otherwise(F.col("columns"))).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    across = F.sequence(F.lit(0), F.when(one_cell | (F.col("side") == 1), F.col("rows")).otherwise(F.col("columns")) - 1)
    places = F.when(one_cell, F.transform(across, lambda o: place(F.least("own", o), F.greatest("own", o), F.col("own") > o))).otherwise(
        F.transform(across, lambda o: place(F.when(F.col("side") == 0, F.col("own")).otherwise(o), F.when(F.col("side") == 0, o).otherwise(F.col("own")), F.col("side")))
    )
    out = met(sided, sizes, ["left", "right"], total).withColumn("own", own).select("node", "left", "right", F.inline(places))
    out = stored(out, "placed")
    for done in (shared, sided, sizes):
        discard(done)
    return out


def verified(reps: DataFrame, chosen: DataFrame, places: DataFrame) -> DataFrame:
    """node, tied, n for each member and pair of blocks in which it has links.

    reps: node, digest, text; chosen: node and the digest of the text that counts, where rows repeat a doc_id.
    """
    # most texts have no candidate: a sieve of SLOTS hash slots at most, which is all that is broadcast, keeps them from the
    # shuffle. With more candidates than slots it lets all texts through, and each is shuffled once.
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS))
    slots = places.select(slot.alias("slot")).distinct()
    near = reps.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    texts = near.join(chosen, "node").where("digest = chosen").select("node", "text").join(places, "node")
    return texts.groupBy("left", "right", "i", "j").applyInPandas(links_of_group, "node long, tied long, n long")


def classes(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, most_cells: int = CELLS) -> DataFrame:
    """node, class_id, rep_id, n_links."""
    spark, docs = docs.sparkSession, docs.select(node().alias("node"), "text")
    digest = F.unhex(F.sha2(whole_text(), 256))
    one = docs.groupBy("node").agg(F.min(digest).alias("digest"))
    members = stored(with_least(one, "digest", "node", "rep_id").select("node", "rep_id", "digest"), "classes")
    chosen = members.where("node = rep_id").select("node", F.col("digest").alias("chosen"))
    members = members.select("node", "rep_id")
    reps = docs.select("node", digest.alias("digest"), whole_text().alias("text"))
    signed_reps = signatures(docs).join(chosen.select("node"), "node", "left_semi")
    buckets = stored(signed_reps.select("node", "size", F.explode("buckets").alias("bucket")), "buckets")
    release(spark)
    found = candidates(buckets)
    discard(buckets)
    release(spark)
    held = cells(found, most_cells)
    discard(found)
    places = placed(held, block, block_bytes)
    discard(held)
    release(spark)
    links = stored(verified(reps, chosen, places), "links")
    discard(places)
    release(spark)
    groups = components(links.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    copies = members.groupBy("rep_id").agg(F.count("*").alias("n"))
    linked_to = groups.join(counts, "node", "full").select(F.col("node").alias("rep_id"), "root", "n_links")
    # texts of many copies have facts as well, though there be none, so that they are among the hot keys
    facts = copies.join(linked_to, "rep_id", "left").where("root is not null or n_links is not null or n >= 64")
    facts = stored(facts, "facts")
    total = facts.agg(F.sum("n")).first()[0] or 0
    out = met(members, facts, ["rep_id"], total, "left")
    return out.select("node", F.coalesce("root", "rep_id").alias("class_id"), "rep_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, most_cells: int = CELLS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group of linked classes), rep_id (the least with the same text) and
    n_links (other texts that its text is linked to)."""
    named = F.when(F.col("node") < UNNAMED, F.col("node")).alias("doc_id")
    return classes(docs, block, block_bytes, most_cells).select(named, "class_id", "rep_id", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each group: of the least doc_id."""
    columns = docs.columns
    rows = docs.select(node().alias("node"), F.struct("*").alias("row"))
    kept = classes(docs).where("node = class_id").select("node")
    times = rows.groupBy("node").agg(F.count("*").alias("times"))
    kept = stored(kept.join(times, "node"), "kept")
    # dealt by node at every size, as what is kept grows with the rows
    once = rows.join(kept.where("times = 1").hint("shuffle_hash"), "node", "left_semi")
    again = rows.join(kept.where("times > 1"), "node", "left_semi").groupBy("node").agg(F.min_by("row", F.sha2(F.coalesce("row.text", F.lit("")), 256)).alias("row"))
    return once.select("row.*").unionAll(again.select("row.*")).select(*columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
