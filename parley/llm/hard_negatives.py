"""Hard-negative mining over one-dimensional distance keys.

The score of two vectors of whole numbers is their inner product. With M the greatest norm of the table, a stored vector v gets
one more entry sqrt(M*M - v.v), and a query q a zero: then |q - v|^2 = q.q + M*M - 2 q.v, so high scores are short distances and
a range of scores is an annulus around the query.

Index. Each vector belongs to the nearest of PIVOTS pivots, which k-means finds in a bounded sample; its key is (pivot, distance to
the pivot). The vectors are written sorted by key, in blocks of BLOCK rows, and blocks of one pivot make slices. By the triangle
inequality a vector at distance r from q has a key within r of q's own distance to the pivot, so an annulus is an interval of keys
at each pivot.

Search. Anchors are packed in groups of neighbouring keys, and each group carries what its anchors look for: windows of scores, and
the best k found in each. A first scan takes the slices around the group's own key. What was found bounds the distance that can still
matter; the second scan takes all slices that the intervals of that bound meet and that were not scanned yet, so after it
nothing can be missing. Within a slice the blocks are taken from the nearest key outwards, and left as soon as the bound excludes them
for every anchor. Bounds are widened by far more than rounding; scores are compared as whole numbers and are exact.

Positives are found in one such search, with the anchor's own label and no window; negatives in a second one, with a window of
scores for each positive and the other labels.

A task holds one slice and streams groups past it; a slice is a 512th of the table or SLICE_BYTES, whatever is less, so a pivot
that has a third of all rows, or one vector that does, is many slices. Where keys tell little, as with vectors that have no
clusters, the scans amount to the anchors against all rows, in blocks.

Defined results: rows without id, label or vector, with a null or non-finite entry, with another length than most vectors,
or with a norm of 2**31 or more after scaling, take no part. Repeated ids are rows of their own: an anchor is not its own positive, but
another row with its id is one. Equal scores go by the smaller id. An anchor without positives, or a positive without negatives, gives
no row. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import discard, stored, table
from parley.llm.vectors import dimension, matrix

SCALE = 256
PIVOTS, SAMPLE, ROUNDS = 16, 2048, 8
BLOCK, GROUP = 1024, 256
SLICES, SLICE_BYTES = 512, 64 << 20
SALTS = 16
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score

NONE = np.int64(-(2**63) + 1)  # no score is as low
LAST = np.int64(2**63 - 1)
_SLACK = 1e-9

_VECTORS = "id long, label long, x binary, norm long, anchor boolean"
_KEYED = "id long, label long, x binary, anchor boolean, pivot int, far double"
_BLOCKS = "slice long, pivot int, low double, high double, ids binary, labels binary, x binary"
_GROUPS = f"{_BLOCKS}, most binary, least binary, score binary, found binary, positive binary, positive_score binary"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _matrix(cells, d: int, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(-1, d)


def vectors(rows: DataFrame, d: int, scale: float) -> DataFrame:
    """id, label, embedding, anchor -> the usable rows as _VECTORS, with whole-number entries."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(2), d)
            with np.errstate(over="ignore"):
                values = np.floor(values * scale)
                fits = np.sqrt((values * values).sum(axis=1)) < 2.0**31 - 1
            at, x = at[fits], values[fits].astype(np.int64)
            kept = batch.take(pa.array(at))
            columns = [kept.column(0), kept.column(1), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()), pa.array((x * x).sum(axis=1)), kept.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "norm", "anchor"])

    named = rows.where("id is not null and label is not null and embedding is not null")
    return named.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding", "anchor").mapInArrow(whole, _VECTORS)


@dataclass
class Space:
    """What every task knows: the dimension, the greatest squared norm, the pivots, and the rows of a slice."""

    d: int
    most: int
    pivots: np.ndarray
    slice_rows: int

    @property
    def kind(self):
        """A type in which scores, and all sums on the way to them, are exact."""
        return np.float32 if self.most < 1 << 24 else np.float64 if self.most < 1 << 53 else np.int64

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """From points with d + 1 entries to each pivot."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([x.astype(float), np.zeros((len(x), 1))]))


def _pivots(points: np.ndarray) -> np.ndarray:
    """k-means from the points that are farthest from those before them."""
    points = np.unique(points, axis=0)
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen]
    for _ in range(ROUNDS):
        near = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)
        centres = np.stack([points[near == k].mean(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


def space(made: DataFrame, d: int) -> Space | None:
    """Fitted on SAMPLE rows of least hash; the greatest norm and the number of rows are those of all."""
    known = made.agg(F.max("norm").alias("most"), F.count("*").alias("n")).first()
    if not known["n"]:
        return None
    sample = made.orderBy(F.xxhash64("id"), "id", "norm").limit(SAMPLE).select("x").collect()
    slice_rows = max(BLOCK, min(-(-known["n"] // SLICES), SLICE_BYTES // (4 * d)))
    found = Space(d, known["most"], np.zeros((0, d + 1)), slice_rows)
    found.pivots = _pivots(found.lifted(_matrix([r["x"] for r in sample], d)))
    return found


def keyed(made: DataFrame, where: Space) -> DataFrame:
    """Each vector with its nearest pivot and the distance to it: in sorted order."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = where.distances(where.lifted(_matrix(batch.column(2).to_pylist(), where.d)))
            pivot = gaps.argmin(axis=1)
            columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(pivot.astype(np.int32)), pa.array(gaps[np.arange(len(pivot)), pivot])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "x", "anchor", "pivot", "far"])

    order = ["pivot", "far", "id", "label"]  # the id deals out what one vector has
    return made.mapInArrow(keys, _KEYED).repartitionByRange(*order).sortWithinPartitions(*order)


def packed(rows: DataFrame, block: int, slice_rows: int) -> DataFrame:
    """Sorted rows -> _BLOCKS. A block's rows stand by id; a slice is a run of blocks of one pivot within a task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, last, held = TaskContext.get().partitionId(), 0, 0, None, []

        def write() -> pa.RecordBatch:
            nonlocal number, size, last
            ids, labels, pivots, far = (np.concatenate([h[k] for h in held]) for k in range(4))
            x = [v for h in held for v in h[4]]
            if last != pivots[0] or size + len(ids) > slice_rows:
                number, size, last = number + 1, 0, pivots[0]
            size += len(ids)
            order = np.argsort(ids, kind="stable")
            cells = [(task << 32) + number, int(pivots[0]), far.min(), far.max(), ids[order].tobytes(), labels[order].tobytes(), b"".join(x[k] for k in order)]
            held.clear()
            names = ["slice", "pivot", "low", "high", "ids", "labels", "x"]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells[:1]] + [pa.array(cells[1:2], pa.int32())] + [pa.array([c]) for c in cells[2:]], names=names)

        for batch in batches:
            ids, labels, x, pivots, far = _columns(batch, "id", "label", "x", "pivot", "far")
            at = 0
            while at < len(ids):
                if held and held[0][2][0] != pivots[at]:
                    yield write()
                room = block - sum(len(h[0]) for h in held)
                to = min(at + room, at + int((np.append(pivots[at:], -1) != pivots[at]).argmax()))
                held.append((ids[at:to], labels[at:to], pivots[at:to], far[at:to], x[at:to].tolist()))
                at = to
                if sum(len(h[0]) for h in held) == block:
                    yield write()
        if held:
            yield write()

    return rows.mapInArrow(pack, _BLOCKS)


class Group:
    """A group of anchors: what they look for, and what they have found.

    most, least: anchors x windows, the scores that are looked for; score, found: anchors x windows x k, the best scores and their
    ids, best first, NONE and LAST where there is none yet; bar: the last of k scores that were found before. A scan starts
    afresh, so that what it finds is told once.
    """

    def __init__(self, row: dict, where: Space, k: int, afresh: bool = False):
        self.row = row
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["x"], np.int32).reshape(-1, where.d)
        n = len(self.ids)
        self.most, self.least = (np.frombuffer(row[c], np.int64).reshape(n, -1) for c in ("most", "least"))
        self.score, self.found = (np.frombuffer(row[c], np.int64).reshape(n, -1, k).copy() for c in ("score", "found"))
        self.bar = self.score[:, :, -1].copy()
        if afresh:
            self.score[:], self.found[:] = NONE, LAST
        self.away = where.queries(self.x)
        norms = (self.x.astype(float) ** 2).sum(axis=1)
        self.sum = (norms + where.most)[:, None]

    def interval(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys at each pivot that may still hold something for some anchor: from, to. Empty ones have from > to."""
        need = np.maximum(np.maximum(self.least, self.bar), self.score[:, :, -1]).astype(float)
        wide = np.sqrt(np.maximum(self.sum - 2 * need, 0.0))
        inner = np.sqrt(np.maximum(self.sum - 2 * self.most.astype(float), 0.0))
        open_ = self.most.astype(float) >= need
        wide, inner = np.where(open_, wide, -np.inf).max(axis=1), np.where(open_, inner, np.inf).min(axis=1)
        slack = _SLACK * (1 + self.away + np.sqrt(self.sum))
        low = np.maximum(self.away - wide[:, None], inner[:, None] - self.away) - slack
        high = self.away + wide[:, None] + slack
        return np.where(high >= low, low, np.inf).min(axis=0), np.where(high >= low, high, -np.inf).max(axis=0)

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, same: bool) -> bool:
        """Counts in a block whose rows stand by id. Whether something better was found."""
        fits, better = (labels[None, :] == self.labels[:, None]) == same, False
        floor = scores.dtype.type(-np.inf) if scores.dtype.kind == "f" else NONE
        for w in range(self.most.shape[1]):
            seen = np.where(fits & (scores <= self.most[:, w, None]) & (scores >= self.least[:, w, None]), scores, floor)
            best, last = seen.max(axis=1), np.maximum(self.bar[:, w], self.score[:, w, -1])
            for a in np.flatnonzero((best > floor) & (best >= last)).tolist():
                better |= self._insert(a, w, seen[a], ids, floor)
        return better

    def _insert(self, a: int, w: int, seen: np.ndarray, ids: np.ndarray, floor) -> bool:
        k = self.score.shape[2]
        at = np.flatnonzero((seen > floor) & (seen >= max(self.bar[a, w], self.score[a, w, -1])))
        if len(at) > k:
            cut = np.partition(seen[at], len(at) - k)[len(at) - k]
            above, level = at[seen[at] > cut], at[seen[at] == cut]
            at = np.concatenate([above, level[: k - len(above)]])  # the first of equal scores have the smallest ids
        return self.put(a, w, seen[at].astype(np.int64), ids[at])

    def put(self, a: int, w: int, score: np.ndarray, ids: np.ndarray) -> bool:
        k = self.score.shape[2]
        score, ids = np.concatenate([self.score[a, w], score]), np.concatenate([self.found[a, w], ids])
        order = np.lexsort((ids, -score))[:k]
        changed = bool((order >= k).any())
        self.score[a, w], self.found[a, w] = score[order], ids[order]
        return changed


_SCAN = f"part int, groups long, {_GROUPS}"


def _scanned(work: DataFrame, where: Space, k: int, same: bool) -> DataFrame:
    """Rows of _SCAN dealt by slice, each slice's blocks (part 0) before the groups (part 1) -> what each group found in each slice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["part"] == 0:
                    if row["slice"] != now:
                        now, blocks = row["slice"], []
                    x = np.frombuffer(row["x"], np.int32).reshape(-1, where.d).astype(where.kind)
                    blocks.append((row["pivot"], row["low"], row["high"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x))
                elif row["slice"] == now:
                    yield from look(row, blocks)

    def look(row: dict, blocks: list) -> Iterator[pa.RecordBatch]:
        group, better = Group(row, where, k, afresh=True), False
        q = group.x.astype(where.kind)
        nearest, farthest = group.away.min(axis=0), group.away.max(axis=0)
        low, high = group.interval()
        for pivot, start, end, ids, labels, x in sorted(blocks, key=lambda b: max(nearest[b[0]] - b[2], b[1] - farthest[b[0]], 0.0)):
            if start <= high[pivot] and end >= low[pivot] and group.take(ids, labels, q @ x.T, same):
                better = True
                low, high = group.interval()
        if better:
            names, cells = ["groups", "score", "found"], [row["groups"], group.score.tobytes(), group.found.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=names)

    dealt = work.repartition("slice").sortWithinPartitions("slice", "part", "low")
    return dealt.mapInArrow(scan, "groups long, score binary, found binary")


def _merged(groups: DataFrame, found: DataFrame, where: Space, k: int) -> DataFrame:
    """groups with the best of what they had and found, and the intervals of keys that may still matter."""
    names = [f.name for f in groups.schema]
    own = groups.select(F.col("slice").alias("groups"), F.lit(0).alias("part"), *names)
    more = found.select("groups", F.lit(1).alias("part"), *[(F.col(c) if c in ("score", "found") else F.lit(None).cast(groups.schema[c].dataType)).alias(c) for c in names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def done() -> pa.RecordBatch:
            low, high = group.interval()
            cells = group.row | {"score": group.score.tobytes(), "found": group.found.tobytes(), "from_key": low.tolist(), "to_key": high.tolist()}
            return pa.RecordBatch.from_pylist([cells], schema=schema)

        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["part"] == 0:
                    if group is not None:
                        yield done()
                    group = Group({c: row[c] for c in names}, where, k)
                    continue
                score, ids = (np.frombuffer(row[c], np.int64).reshape(group.score.shape) for c in ("score", "found"))
                for a, w in np.argwhere(score[:, :, 0] > NONE).tolist():
                    group.put(a, w, score[a, w], ids[a, w])
        if group is not None:
            yield done()

    spec = f"{_GROUPS}, from_key array<double>, to_key array<double>"
    schema = pa.schema([(n, _ARROW[n]) for n in names] + [("from_key", pa.list_(pa.float64())), ("to_key", pa.list_(pa.float64()))])
    dealt = own.unionAll(more).repartition("groups").sortWithinPartitions("groups", "part")
    return dealt.mapInArrow(merge, spec)


_ARROW = dict.fromkeys(("ids", "labels", "x", "most", "least", "score", "found", "positive", "positive_score"), pa.binary())
_ARROW |= {"slice": pa.int64(), "pivot": pa.int32(), "low": pa.float64(), "high": pa.float64()}


def _meeting(intervals: DataFrame, slices: DataFrame) -> DataFrame:
    """groups, pivot, low, high and slice, pivot, low, high -> slice, groups where they overlap. A pivot is dealt over SALTS keys."""
    asked = intervals.select("groups", "pivot", F.col("low").alias("a"), F.col("high").alias("b"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    kept = slices.select("slice", "pivot", "low", "high", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).cast("int").alias("salt"))
    return asked.join(kept, ["pivot", "salt"]).where("a <= high and b >= low").select("slice", "groups")


def search(index: DataFrame, slices: DataFrame, groups: DataFrame, where: Space, k: int, same: bool) -> DataFrame:
    """The groups with the k best of each window in all of the index, among rows of the same label or of other ones."""
    names = [f.name for f in groups.schema]
    blocks = index.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("groups"), *[F.col(n) if n in index.columns else F.lit(None).cast("binary").alias(n) for n in names])

    def scanned(pairs: DataFrame, state: DataFrame) -> DataFrame:
        asked = state.select(F.col("slice").alias("groups"), *[n for n in names if n not in ("slice", "positive", "positive_score")]).join(pairs, "groups")
        asked = asked.select(F.lit(1).alias("part"), "groups", *[F.col(n) if n not in ("positive", "positive_score") else F.lit(None).cast("binary").alias(n) for n in names])
        return _scanned(blocks.unionAll(asked), where, k, same)

    near = stored(_meeting(groups.select(F.col("slice").alias("groups"), "pivot", "low", "high"), slices), "pairs")
    first = stored(_merged(groups, scanned(near, groups), where, k), "near")
    reach = first.select(F.col("slice").alias("groups"), F.posexplode(F.arrays_zip("from_key", "to_key")).alias("pivot", "keys"))
    reach = reach.select("groups", "pivot", F.col("keys.from_key").alias("low"), F.col("keys.to_key").alias("high")).where("low <= high")
    rest = stored(_meeting(reach, slices).join(near, ["slice", "groups"], "left_anti"), "pairs")
    out = stored(_merged(first.select(*names), scanned(rest, first), where, k).select(*names), "found")
    for x in (near, first, rest):
        discard(x)
    return out


def _started(groups: DataFrame) -> DataFrame:
    """_BLOCKS of anchors -> _GROUPS that look for one more than POSITIVES, as an anchor finds itself."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                wide = {"most": np.full(n, LAST), "least": np.full(n, NONE), "score": np.full(n * (POSITIVES + 1), NONE), "found": np.full(n * (POSITIVES + 1), LAST)}
                empty = {"positive": b"", "positive_score": b""}
                yield pa.RecordBatch.from_pylist([row | {c: v.tobytes() for c, v in wide.items()} | empty], schema=pa.schema([(f, _ARROW[f]) for f in (*row, *wide, *empty)]))

    return groups.mapInArrow(start, _GROUPS)


def _windows(groups: DataFrame, where: Space) -> DataFrame:
    """Groups with their positives -> groups that look for negatives, in a window of scores for each positive."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = Group(row, where, POSITIVES + 1)
                n = len(group.ids)
                score, ids = group.score[:, 0], group.found[:, 0]
                own = (ids == group.ids[:, None]) & (score == (group.x.astype(np.int64) ** 2).sum(axis=1)[:, None])
                drop = np.where(own.any(axis=1), own.argmax(axis=1), POSITIVES)
                kept = np.arange(POSITIVES + 1)[None, :] != drop[:, None]
                score, ids = score[kept].reshape(n, POSITIVES), ids[kept].reshape(n, POSITIVES)
                held, whole = score > NONE, np.where(score > NONE, score, 0)
                tens, rest = np.divmod(whole, 100)
                most = np.where(held, HIGHEST * tens + HIGHEST * rest // 100, NONE)
                least = np.where(held, LOWEST * tens - (-LOWEST * rest) // 100, LAST)
                cells = {"most": most, "least": least, "score": np.full(n * POSITIVES * NEGATIVES, NONE), "found": np.full(n * POSITIVES * NEGATIVES, LAST), "positive": ids, "positive_score": score}
                yield pa.RecordBatch.from_pylist([row | {c: np.ascontiguousarray(v).tobytes() for c, v in cells.items()}], schema=pa.schema([(f, _ARROW[f]) for f in row]))

    return groups.mapInArrow(turn, _GROUPS)


def _told(groups: DataFrame, where: Space) -> DataFrame:
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = Group(row, where, NEGATIVES)
                positive, score = (np.frombuffer(row[c], np.int64).reshape(-1, POSITIVES) for c in ("positive", "positive_score"))
                a, w, r = np.nonzero(group.score > NONE)
                columns = [group.ids[a], positive[a, w], (r + 1).astype(np.int32), group.found[a, w, r], score[a, w], group.score[a, w, r]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=[c.split()[0] for c in _OUT.split(", ")])

    return groups.mapInArrow(tell, _OUT)


def mine(rows: DataFrame, anchor: Column, scale: float = SCALE) -> DataFrame:
    """rows (vec_id, label, embedding) -> for each anchor row and each of its positives the hardest negatives, best first."""
    flagged = rows.select(F.col("vec_id").alias("id"), "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    d = dimension(flagged, "embedding")
    made = stored(vectors(flagged, d, scale), "vectors")
    where = space(made, d)
    if where is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    order = keyed(made, where)
    index = stored(packed(order, BLOCK, where.slice_rows), "index")
    groups = stored(_started(packed(keyed(made.where("anchor"), where), GROUP, GROUP)), "groups")
    slices = stored(index.groupBy("slice", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")), "slices")
    with_positives = search(index, slices, groups, where, POSITIVES + 1, True)
    turned = stored(_windows(with_positives, where), "windows")
    with_negatives = search(index, slices, turned, where, NEGATIVES, False)
    for x in (made, index, groups, slices, with_positives, turned):
        discard(x)
    return _told(with_negatives, where)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)
