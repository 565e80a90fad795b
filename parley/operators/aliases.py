"""Equivalent names across scripts: consonant skeletons, how near each is to those of the other script, and the one suggestion of each word.

A Han word that is written with transliteration characters only, and a Latin word, both reduce to the classes of their consonants.
Two skeletons belong together if their edit similarity is SIMILAR or more. Half of the letters may differ, so an index of pieces (`piece_keys`
and `place_keys`, for thresholds that leave pieces long) meets nearly all pairs several times over. Skeletons of the two sides are
dealt into blocks instead, and each pair of blocks is one task's: the rows of the distance table of one skeleton and all those of a block
are single numbers, so a step of all of them is a dozen operations on arrays, and skeletons with the same beginning share its steps.
Words come in after that, one row for each skeleton and side, so a skeleton that thousands of words share costs one. Where only the best
is asked for, a block gives one row for each of its skeletons, and no pair leaves it.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.session import cut

# The weights of what may be suggested unasked, the least similarity of skeletons, and the score above which a word is.
TOGETHER, SOUND, SIMILAR, ENOUGH = 12.0, 8.0, 0.55, 3.5


def han_skeleton(word: Column, sounds: dict[str, str]) -> Column:
    """Classes of the characters' initials, neighbours of one class once; null for words with other characters. sounds: class to the
    characters that begin with it; those of the class '' begin with a vowel."""
    spoken = [(c, k) for k, characters in sounds.items() if k for c in characters]
    every = "".join(sounds.values())
    classes = F.translate(F.translate(word, sounds.get("", ""), ""), "".join(c for c, _ in spoken), "".join(k for _, k in spoken))
    return F.when((word != "") & (F.translate(word, every, "") == ""), F.regexp_replace(classes, r"(.)\1+", "$1"))


def most_edits(a: int, b: int, similar: float = SIMILAR) -> int:
    """So many edits leave two strings of these lengths similar."""
    return math.floor((1 - similar) * max(a, b) + 1e-9)


def _cuts(length: int, pieces: int) -> list[tuple[int, int]]:
    """Start and end of pieces of like size."""
    return [(k * length // pieces, (k + 1) * length // pieces) for k in range(pieces)]


def _lengths(n: int, similar: float) -> range:
    return range(max(2, math.ceil(n * similar - 1e-9)), math.floor(n / similar + 1e-9) + 1)


def piece_keys(skeleton: str, similar: float = SIMILAR) -> list[str]:
    """Keys of the side that is cut: own length, other length, piece, what it holds."""
    n = len(skeleton)
    return [f"{n}.{m}.{k}.{skeleton[a:b]}" for m in _lengths(n, similar) for k, (a, b) in enumerate(_cuts(n, most_edits(n, m, similar) + 1))]


def place_keys(skeleton: str, similar: float = SIMILAR) -> list[str]:
    """Keys of the side that is searched: what stands where a piece of another skeleton may."""
    m, out = len(skeleton), set()
    for n in _lengths(m, similar):
        most = most_edits(n, m, similar)
        for k, (a, b) in enumerate(_cuts(n, most + 1)):
            for at in range(max(0, a - most), min(m - (b - a), a + most) + 1):
                out.add(f"{n}.{m}.{k}.{skeleton[at : at + b - a]}")
    return sorted(out)


#: So many skeletons are in a block of either side.
STEPPED, HELD = 4096, 16384
MILLIONTH = Decimal("0.000001")


class Block:
    """Skeletons as columns of bits, to be compared with one skeleton at a time."""

    def __init__(self, skeletons: list[str], similar: float):
        self.sizes = np.array([len(s) for s in skeletons], np.int64)
        longest = int(self.sizes.max(initial=1))
        self.similar, self.shortest, self.longest = similar, int(self.sizes.min(initial=longest)), longest
        # beyond 64 letters the bits are whole numbers of Python, which have any number of them
        self.kind = next((k for bits, k in ((16, np.uint16), (32, np.uint32), (64, np.uint64)) if longest <= bits), object)
        number = int if self.kind is object else self.kind
        self.one, self.full = number(1), number((1 << (longest if self.kind is object else np.iinfo(self.kind).bits)) - 1)
        self.of = np.array([number((1 << n) - 1) for n in self.sizes.tolist()], self.kind)
        self.none = np.array([number(0)] * len(skeletons), self.kind)
        self.letters: dict[str, np.ndarray] = {}
        every = np.array(list("".join(skeletons)), "U1") if skeletons else np.empty(0, "U1")
        row = np.repeat(np.arange(len(skeletons)), self.sizes)
        place = np.arange(len(every)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        for c in np.unique(every).tolist():
            self.letters[c] = held = self.none.copy()
            for j in np.unique(place[at := np.flatnonzero(every == c)]).tolist():
                held[row[at[place[at] == j]]] |= number(1 << j)
        self.states, self.at = [(np.full_like(self.none, self.full), self.none.copy())], ""
        self.most: dict[int, np.ndarray] = {}

    def near(self, skeleton: str) -> tuple[np.ndarray, np.ndarray]:
        """Which ones are similar, and by how many edits they differ; fastest if skeletons come in order."""
        n = len(skeleton)
        if n < self.shortest * self.similar - 1e-9 or self.longest < n * self.similar - 1e-9:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        same = 0
        while same < min(n, len(self.at)) and skeleton[same] == self.at[same]:
            same += 1
        for k in range(same, n):
            self._step(k, self.letters.get(skeleton[k], self.none))
        self.at = skeleton
        up, down = self.states[n]
        count = np.vectorize(int.bit_count, otypes=[np.int64]) if self.kind is object else np.bitwise_count
        # no more than the longest length, so no smaller type is needed than that of the lengths of a block
        edits = n + count(up & self.of).astype(np.int16 if self.longest + n < 1 << 14 else np.int64) - count(down & self.of)
        if n not in self.most:
            self.most[n] = np.array([most_edits(n, int(m), self.similar) for m in range(self.longest + 1)], edits.dtype)[self.sizes]
        found = np.flatnonzero(edits <= self.most[n])
        return found, edits[found].astype(np.int64)

    def _step(self, k: int, equal: np.ndarray) -> None:
        """Column k + 1 of all distance tables: where a row is one more (up) or one less (down) than the row above it. The method is
        Myers', in Hyyro's form for whole strings."""
        if len(self.states) == k + 1:
            self.states.append((self.none.copy(), self.none.copy()))
        (up, down), (new_up, new_down) = self.states[k], self.states[k + 1]
        level = equal & up
        level += up
        level ^= up
        level |= equal
        level |= down
        right = level | up
        right ^= self.full
        right |= down
        right <<= self.one
        right |= self.one
        if self.kind is object:
            level &= self.full
            right &= self.full
        np.bitwise_and(right, level, out=new_down)
        right |= level
        right ^= self.full
        level &= up
        level <<= self.one
        if self.kind is object:
            level &= self.full
        np.bitwise_or(right, level, out=new_up)


def _dealt(left: DataFrame, right: DataFrame, key: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides in blocks (i, j) of STEPPED and HELD skeletons, each block of one beside each of the other, within each value of key."""
    of, sides = [key] if key else [], []
    counts = [x.groupBy(*of).agg(F.count("*").alias(f"_{name}")) for x, name in ((left, "left"), (right, "right"))]
    both = counts[0].join(counts[1], key) if key else counts[0].crossJoin(counts[1])
    both = both.select(*of, *[F.ceil(F.greatest(F.lit(1), F.col(c)) / size).cast("int").alias(c) for c, size in (("_left", STEPPED), ("_right", HELD))])
    for x, own, other, names in ((left, "_left", "_right", "ij"), (right, "_right", "_left", "ji")):
        rows = x.join(both, key) if key else x.crossJoin(F.broadcast(both))
        block = F.pmod(F.xxhash64("skeleton"), F.col(own)).cast("int").alias(names[0])
        sides.append(rows.select(*[F.col(c).alias(c) for c in x.columns], block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])))
    return sides[0], sides[1]


def _met(left: DataFrame, right: DataFrame, key: str | None, compare, schema: str) -> DataFrame:
    """compare of each pair of blocks; their rows are few and their work is long, so partitions of few bytes stay apart."""
    by = ([key] if key else []) + ["i", "j"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of, other = (x.repartition(parts, *by).groupBy(*by) for x in _dealt(left, right, key))
    return of.cogroup(other).applyInArrow(compare, schema)


def alike(left: DataFrame, right: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """skeleton of each side -> a, b, similarity: all pairs of skeletons of two classes or more with an edit similarity of `similar`."""
    sides = [cut(x.select("skeleton").where(F.length("skeleton") >= 2).distinct()) for x in (left, right)]

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        a, b = (x.column("skeleton").combine_chunks() for x in (ours, theirs))
        block, steps, found = Block(b.to_pylist(), similar), a.to_pylist(), []
        for k in sorted(range(len(steps)), key=steps.__getitem__):
            which, edits = block.near(steps[k])
            found.append((np.full(len(which), k, np.int32), which.astype(np.int32), edits.astype(np.int32)))
        of, which, edits = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (zip(*found) if found else ((), (), ())))
        longest = np.maximum(np.array([len(s) for s in steps], np.int64)[of], block.sizes[which])
        cases, case = np.unique(longest << 32 | edits, return_inverse=True)
        values = [1 - (x & 0xFFFFFFFF) / (x >> 32) for x in cases.tolist()]
        kept = np.array([v >= similar for v in values], bool)[case]
        shown = np.array([float(Decimal(repr(v)).quantize(MILLIONTH, ROUND_HALF_UP)) for v in values])[case]
        return pa.table({"a": a.take(pa.array(of[kept])), "b": b.take(pa.array(which[kept])), "similarity": pa.array(shown[kept], pa.float64())})

    return _met(*sides, None, compare, "a string, b string, similarity double")


def nearest(best: DataFrame, similar: float = SIMILAR, key: str | None = None) -> DataFrame:
    """side, skeleton, top (n, word), and the column key if it is given -> key, side, skeleton, found: for each skeleton that is similar to
    one of the other side with the same key the score and top of the most similar one; of equals, of the one with the least top."""
    of = [key] if key else []
    rows = cut(best.where(F.length("skeleton") >= 2).select(*of, "side", "skeleton", F.col("top.n").alias("n"), F.col("top.word").alias("word")))
    sides = [rows.where(F.col("side") == s).drop("side") for s in ("han", "latin")]
    told = T.StructType([*(rows.schema[c] for c in of), T.StructField("side", T.StringType()), rows.schema["skeleton"], T.StructField("edits", T.IntegerType()), T.StructField("longest", T.IntegerType()), rows.schema["n"], rows.schema["word"]])
    columns = to_arrow_schema(told)

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ours, theirs = (x.select([*of, "skeleton", "n", "word"]).to_pylist() for x in (ours, theirs))
        out = []
        if ours and theirs:
            for x in (ours, theirs):
                x.sort(key=lambda r: (r["n"], r["word"]))
            block = Block([r["skeleton"] for r in theirs], similar)
            most, mate, of_edits = np.zeros(len(theirs)), np.zeros(len(theirs), np.int64), np.zeros(len(theirs), np.int64)
            for k in sorted(range(len(ours)), key=lambda k: ours[k]["skeleton"]):
                n = len(ours[k]["skeleton"])
                which, edits = block.near(ours[k]["skeleton"])
                if not len(which):
                    continue
                alike = np.round(1 - edits / np.maximum(n, block.sizes[which]), 6)
                first = int(np.argmax(alike))
                out.append((ours[k], "han", int(edits[first]), theirs[which[first]]))
                better = (alike > most[which]) | ((alike == most[which]) & (k < mate[which]))
                changed = which[better]
                most[changed], mate[changed], of_edits[changed] = alike[better], k, edits[better]
            out += [(theirs[j], "latin", int(of_edits[j]), ours[mate[j]]) for j in np.flatnonzero(most).tolist()]
        values = [(*[r[c] for c in of], side, r["skeleton"], edits, max(len(r["skeleton"]), len(x["skeleton"])), x["n"], x["word"]) for r, side, edits, x in out]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*values) if values else [()] * len(columns), columns.types)], schema=columns)

    value = 1 - F.col("edits") / F.col("longest")
    found = F.struct((-SOUND * F.round(value, 6)).alias("score"), F.struct("n", "word").alias("top"))
    return _met(*sides, key, compare, told.simpleString()[len("struct<") : -1]).where(value >= similar).groupBy(*of, "side", "skeleton").agg(F.min(found).alias("found"))


def suggestions(words: DataFrame, groups: DataFrame | None = None, similar: float = SIMILAR) -> DataFrame:
    """word, n, side (han or latin), skeleton -> word, suggested, score: for each word the one that is most likely the same name.

    groups: word, group of coreference. A suggestion is a member of the word's group or a word of the other script with a similar
    skeleton; the higher score wins, then the more frequent word, then the lesser. Spelling alone suggests nothing.
    """
    top = F.struct((-F.col("n")).alias("n"), "word")
    best = words.where(F.length("skeleton") >= 2).groupBy("side", "skeleton").agg(F.min(top).alias("top"))
    told = words.join(nearest(best, similar), ["side", "skeleton"]).select("word", "found")
    if groups is not None:
        # a member is a candidate for all others, so the first of a group is for all but itself, and for it the second; those that
        # also sound alike score higher, and come from within the group
        members = cut(groups.join(words.select("word", "n", "side", "skeleton"), "word").withColumn("top", top))
        first = members.groupBy("group").agg(F.min("top").alias("first"))
        second = members.join(first, "group").where(F.col("word") != F.col("first.word")).groupBy("group").agg(F.min("top").alias("second"), F.first("first").alias("first"))
        other = F.when(F.col("word") != F.col("first.word"), F.col("first")).otherwise(F.col("second"))
        mates = members.join(second, "group").select("word", F.struct(F.lit(-TOGETHER).alias("score"), other.alias("top")).alias("found"))
        sounds = nearest(members.groupBy("group", "side", "skeleton").agg(F.min("top").alias("top")), similar, "group")
        both = F.struct((F.col("found.score") - TOGETHER).alias("score"), F.col("found.top").alias("top")).alias("found")
        told = told.unionAll(mates).unionAll(members.join(sounds, ["group", "side", "skeleton"]).select("word", both))
    chosen = told.groupBy("word").agg(F.min("found").alias("found"))
    return chosen.select("word", F.col("found.top.word").alias("suggested"), F.round(-F.col("found.score"), 6).alias("score")).where(F.col("score") > ENOUGH)
