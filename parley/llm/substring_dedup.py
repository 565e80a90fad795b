"""Substring deduplication with a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document. A word is removed if it lies in a window whose words also start in
a document with a smaller id. Documents arrive in batches of rising id.

Fingerprints. Of the GRAM-word runs inside a window the one with the least hash is its anchor; equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document has far fewer anchors than windows. A fingerprint is an
anchor of a document and its context, a hash of all windows of that document that have the anchor. Equal fingerprints mean equal
windows, so the least document of a fingerprint speaks for all others, whose windows there are repeats. A run of the index
holds each fingerprint with its least document, dealt into buckets and sorted by anchor, and never changes; beside it stand the
texts of the batch, dealt by document, each with its digest.

A batch is taken in like this. Its fingerprints are written as a run and merge-joined with every run before it; as all runs are
bucketed alike, none of them is shuffled. A fingerprint that a smaller document has is a repeat as a whole. Where an anchor
has several contexts, in the batch or before it, some windows may be equal and others not, as at the ends of a repeated
passage: the windows of that anchor are verified one by one, over the texts of the documents that speak for each context. Then
the documents are cut, and runs of like size are merged into one, so that their number stays logarithmic in the number of
batches. An index that is given is used with all that it holds, and holds the new documents after. What was cut is not cut
again: a document that arrives late, with an id below those of the history, changes no earlier result.

An exact copy needs no windows: all of them start in the first document with that text, of this batch or of the history. So
a hot group of copies costs its ids alone. A passage that many different texts share is reduced to one fingerprint in each slice
of texts before anything is shuffled; the rest of that slice are repeats already.

Windows are told apart by an anchor and a context or digest, of 64 bits each, from two independent hashes of their words; words
that differ hash alike in both with a probability of about (length / 2**31)**4, so no run of the words themselves is compared. Texts
are told apart by sha256.

Defined results: a null or empty text has no words; documents of fewer than WINDOW words lose nothing; several rows with
one doc_id are judged as that document each, and are no copies of one another; a row without doc_id is smaller than none,
so nothing is removed from it or because of it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, discard, release, stored, table, whole_text, with_least
from parley.llm.words import Words, mixed, signed, slices, windows

WINDOW = 13
GRAM = 6
#: With runs merged by pairs, the last of three batches meets a merged run.
BATCHES, FAN = 3, 2
SLICE = 2 << 20  # bytes of text whose windows a task holds at once

_GRAM_SALT, _CONTEXT_SALT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Windows:
    """The windows of a run of texts: index of the first word, text, anchor, digest and context of each; and the fingerprints:
    text, anchor and context of each."""

    first: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray
    context: np.ndarray
    text_of: np.ndarray
    anchor_of: np.ndarray
    context_of: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Windows:
        h = words.hashes()
        digest, first = windows(words.hashes(1), words.word_at, WINDOW)
        if not len(first):
            return cls(first, first, digest, digest, digest, first, digest, digest)
        text = np.searchsorted(words.word_at, first, "right") - 1
        least = mixed(windows(h, np.array([0, len(h)]), GRAM)[0] ^ _GRAM_SALT)
        width, span = WINDOW - GRAM + 1, 1
        while span * 2 <= width:  # the least of `width` neighbours, by doubling
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = least[first]
        # neighbours with one anchor make a run; the runs of one text and anchor make a fingerprint
        heads = np.flatnonzero(_changes(text, anchor))
        total = np.add.reduceat(mixed(digest ^ _CONTEXT_SALT), heads)
        order = np.lexsort((anchor[heads], text[heads]))
        starts = np.flatnonzero(_changes(text[heads][order], anchor[heads][order]))
        context_of = mixed(np.add.reduceat(total[order], starts))
        number = np.empty(len(heads), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(heads))))
        context = np.repeat(context_of[number], np.diff(np.append(heads, len(first))))
        return cls(first, text, anchor, digest, context, text[heads][order][starts], anchor[heads][order][starts], context_of)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _least(ids: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold the least id of their key, one for each key, and the rows that hold a greater one."""
    order = np.lexsort((ids, *key[::-1]))
    new = _changes(*(k[order] for k in key))
    heads = order[new]
    of = np.cumsum(new) - 1
    return heads, order[ids[order] > ids[heads][of]] if len(order) else order


def _lists(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct ids, and a list of values for each."""
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(_changes(ids[order]))
    return ids[order][heads], pa.ListArray.from_arrays(pa.array(np.append(heads, len(ids)), pa.int32()), pa.array(signed(values[order])))


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column(part.schema.get_field_index("doc_id")))


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_FINGERPRINTS = pa.schema([("place", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("repeats", pa.list_(pa.int64()))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> place, context, doc_id, repeats.

    A row with a context is a fingerprint whose anchor is `place`, with its least document of a slice of texts. For the other
    documents of the slice it is a repeat: their repeated contexts are in rows of their own, placed by document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, most=SLICE):
                w = Windows.of(words)
                ids = _ids(part)[w.text_of]
                first, again = _least(ids, w.anchor_of, w.context_of)
                yield _batch(_FINGERPRINTS, len(first), place=pa.array(signed(w.anchor_of[first])), context=pa.array(signed(w.context_of[first])), doc_id=pa.array(ids[first]))
                if len(again):
                    owner, repeats = _lists(ids[again], w.context_of[again])
                    yield _batch(_FINGERPRINTS, len(owner), place=pa.array(signed(mixed(owner.view(np.uint64)))), doc_id=pa.array(owner), repeats=repeats)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(rows, "place long, context long, doc_id long, repeats array<long>")


_SEEN = pa.schema([("place", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("repeats", pa.list_(pa.int64()))])


def windows_at(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors -> place, digest, doc_id, repeats: the windows of each document that have one of its anchors.

    As with fingerprints, only the least document of a slice has a window as a row, placed by its anchor; what the others hold of
    it are repeats.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch, most=SLICE):
                w = Windows.of(words)
                wanted = part.column(part.schema.get_field_index("anchors"))
                cut = np.searchsorted(w.text, np.arange(part.num_rows + 1))
                held = np.zeros(len(w.first), bool)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    held[a:b] = np.isin(w.anchor[a:b].view(np.int64), np.asarray(wanted[k].values))
                ids, anchor, digest = _ids(part)[w.text[held]], w.anchor[held], w.digest[held]
                first, again = _least(ids, anchor, digest)
                yield _batch(_SEEN, len(first), place=pa.array(signed(anchor[first])), digest=pa.array(signed(digest[first])), doc_id=pa.array(ids[first]))
                if len(again):
                    owner, repeats = _lists(ids[again], digest[again])
                    yield _batch(_SEEN, len(owner), place=pa.array(signed(mixed(owner.view(np.uint64)))), doc_id=pa.array(owner), repeats=repeats)

    return docs.select("doc_id", "text", "anchors").mapInArrow(rows, "place long, digest long, doc_id long, repeats array<long>")


@dataclass(frozen=True)
class Run:
    """One run: the table `name` has the fingerprints, and `name`_texts the texts."""

    name: str
    level: int


class FingerprintIndex:
    """Sorted immutable runs as bucketed tables in the warehouse, which all executors share."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        self.made = 0

    def new(self, level: int = 0) -> Run:
        self.made += 1
        return Run(f"{self.name}_{self.made}", level)

    def _save(self, rows: DataFrame, name: str, by: str | None = None, order: bool = False) -> None:
        writer = rows.write.format("parquet").option("compression", "zstd")
        if by:
            writer = writer.bucketBy(self.buckets, by)
        (writer.sortBy(by) if order else writer).saveAsTable(name)

    def texts(self, run: Run) -> DataFrame:
        """doc_id, text, key, copied."""
        return self.spark.table(f"{run.name}_texts")

    def fresh(self, run: Run) -> DataFrame:
        return self.spark.table(run.name)

    def least(self, run: Run) -> DataFrame:
        """place, context and the least document of each fingerprint of a run."""
        return self.fresh(run).where("context is not null").groupBy("place", "context").agg(F.min("doc_id").alias("first"))

    def firsts(self) -> DataFrame | None:
        """key, first of all runs."""
        held = [self.texts(run).where("not copied and doc_id is not null").select("key", F.col("doc_id").alias("first")) for run in self.runs]
        return reduce(DataFrame.unionAll, held) if held else None

    def add(self, texts: DataFrame) -> Run:
        """Writes a run of texts (doc_id, text, key, copied; dealt by doc_id). It does not count before it is in `runs`."""
        run = self.new()
        self._save(texts, f"{run.name}_texts", "doc_id")
        made = fingerprints(self.texts(run).where("not copied"))
        self._save(made.repartition(self.buckets, "place"), run.name, "place", order=True)  # one file a bucket
        return run

    def compared(self, run: Run) -> DataFrame:
        """doc_id, mark, anchor: fingerprints of a new run. mark: the context, where a smaller document has it; anchor: where the
        document speaks for a context of an anchor that has others."""
        same, near = Window.partitionBy("place", "context"), Window.partitionBy("place")
        rows = self.fresh(run).where("context is not null").select(
            "place", "context", "doc_id", F.min("doc_id").over(same).alias("first"), F.min("context").over(near).alias("low"), F.max("context").over(near).alias("high")
        )
        for before in self.runs:
            least = self.least(before)
            spread = least.groupBy("place").agg(F.min("context").alias("low_before"), F.max("context").alias("high_before"))
            rows = rows.join(least.withColumnRenamed("first", "before").hint("merge"), ["place", "context"], "left").join(spread.hint("merge"), "place", "left")
            rows = rows.select(
                "place", "context", "doc_id", F.least("first", "before").alias("first"), F.least("low", "low_before").alias("low"), F.greatest("high", "high_before").alias("high")
            )
        again = F.col("doc_id") > F.col("first")
        marked = rows.select("doc_id", F.when(again, F.col("context")).alias("mark"), F.when(~again & (F.col("low") < F.col("high")), F.col("place")).alias("anchor"))
        return marked.where("mark is not null or anchor is not null")

    def verified(self, run: Run, compared: DataFrame) -> DataFrame:
        """doc_id, marks: digests of windows of a new run's documents that start in a smaller one, by the anchors to be verified."""
        open_here = compared.where("anchor is not null").select("doc_id", "anchor")
        asked = open_here.select(F.col("anchor").alias("place")).distinct()
        seen = []
        for other in [run, *self.runs]:
            wanted = open_here if other is run else self.least(other).hint("merge").join(asked, "place").select(F.col("first").alias("doc_id"), F.col("place").alias("anchor"))
            wanted = wanted.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
            found = windows_at(self.texts(other).where("not copied").join(wanted.hint("shuffle_hash"), "doc_id"))
            seen.append(found.withColumn("new", F.lit(other is run)))
        least = F.min(F.when(F.col("digest").isNotNull(), F.col("doc_id"))).over(Window.partitionBy("place", "digest"))
        rows = reduce(DataFrame.unionAll, seen).withColumn("least", least).where("new and (repeats is not null or doc_id > least)")
        return rows.select("doc_id", F.coalesce("repeats", F.array("digest")).alias("marks"))

    def compact(self) -> None:
        """Merges runs of one level, once there are `fan` of them, into one of the next level."""
        while True:
            by_level: dict[int, list[Run]] = {}
            for run in self.runs:
                by_level.setdefault(run.level, []).append(run)
            full = next((runs for _, runs in sorted(by_level.items()) if len(runs) >= self.fan), None)
            if full is None:
                return
            merged = full[0]
            for k, run in enumerate(full[1:]):
                last = k == len(full) - 2
                whole = self._merged(merged, run, full[0].level + last)
                self.runs = [whole if x == merged else x for x in self.runs if x != run]
                merged = whole

    def _merged(self, one: Run, two: Run, level: int) -> Run:
        """A run of what two hold. Their buckets are joined in place, which a union would shuffle."""
        run = self.new(level)
        a, b = (self.least(x).withColumnRenamed("first", name).hint("merge") for x, name in ((one, "a"), (two, "b")))
        self._save(a.join(b, ["place", "context"], "full").select("place", "context", F.least("a", "b").alias("doc_id")), run.name, "place", order=True)
        x, y = (self.texts(of).where("not copied and doc_id is not null") for of in (one, two))
        packed = lambda t, name: t.groupBy("doc_id").agg(F.collect_list(F.struct("text", "key")).alias(name)).hint("merge")
        rows = F.concat(*[F.coalesce(F.col(c), F.array()) for c in "ab"])
        both = packed(x, "a").join(packed(y, "b"), "doc_id", "full").select("doc_id", F.inline(rows))
        self._save(both.select("doc_id", "text", "key", F.lit(False).alias("copied")), f"{run.name}_texts", "doc_id")
        self._drop(one)
        self._drop(two)
        return run

    def _drop(self, run: Run) -> None:
        for suffix in ("", "_texts"):
            self.spark.sql(f"drop table if exists {run.name}{suffix}")

    def drop(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digested(words: Words, gone: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """How many words of each text are gone, and the digest of the others, joined by one space."""
    kept = np.flatnonzero(~gone)
    size = words.end[kept] - words.start[kept]
    before = np.concatenate([[0], np.cumsum(size)])
    place = before[:-1] + np.arange(len(kept))  # a space follows each word
    out = np.full(before[-1] + len(kept), 32, np.uint8)
    step = np.arange(before[-1])
    out[np.repeat(place - before[:-1], size) + step] = words.data[np.repeat(words.start[kept] - before[:-1], size) + step]
    cut = np.searchsorted(kept, words.word_at)
    ends = np.append(place, len(out))[cut]
    flat = memoryview(out)
    shas = [hashlib.sha256(flat[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return words.count - np.diff(cut), shas


def _kept(part: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    """The result rows of a slice of texts with their marks."""
    copied, marks = (part.column(part.schema.get_field_index(c)) for c in ("copied", "marks"))
    gone = np.zeros(len(words.start), bool)
    if marks.null_count < part.num_rows:
        w = Windows.of(words)
        hit = np.zeros(len(w.first), bool)
        cut = np.searchsorted(w.text, np.arange(part.num_rows + 1))
        for k in np.flatnonzero(np.asarray(marks.is_valid())).tolist():
            a, b, marked = cut[k], cut[k + 1], np.asarray(marks[k].values)
            hit[a:b] = np.isin(w.context[a:b].view(np.int64), marked) | np.isin(w.digest[a:b].view(np.int64), marked)
        n = len(gone) + 1
        gone = np.cumsum(np.bincount(w.first[hit], minlength=n) - np.bincount(w.first[hit] + WINDOW, minlength=n))[:-1] > 0
    # all windows of a copy start in the first document with its text
    gone |= np.repeat(np.asarray(copied) & (words.count >= WINDOW), words.count)
    removed, shas = _digested(words, gone)
    ids = part.column(part.schema.get_field_index("doc_id"))
    columns = [ids, pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(shas, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(docs: DataFrame) -> DataFrame:
    """The result rows of docs (doc_id, text, copied, marks)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(batch.schema.get_field_index("marks")).is_valid()
            for some in (batch.filter(marked), batch.filter(pc.invert(marked))):  # only texts with marks need their windows
                for part, words in slices(some, most=SLICE):
                    yield _kept(part, words)

    return docs.select("doc_id", "text", "copied", "marks").mapInArrow(rows, KEPT)


@contextmanager
def bucketed(spark: SparkSession) -> Iterator[None]:
    """Within it, tables that are dealt by some of a join's keys are joined where they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _arrived(docs: DataFrame, ids: DataFrame, index: FingerprintIndex) -> DataFrame:
    """The result rows of one batch (doc_id, text, and their doc_id, key), which is added to the index."""
    ids = ids.where("doc_id is not null")
    # copies of whole texts: of each text only the first document counts
    known = ids.select("doc_id", "key", F.lit(False).alias("past"))
    past = index.firsts()
    if past is not None:
        known = known.unionAll(past.select(F.col("first").alias("doc_id"), "key", F.lit(True)))
    copies = with_least(known, "key", "doc_id", "first").where("not past and doc_id > first")
    copies = stored(copies.groupBy("doc_id").agg(F.collect_set("key").alias("copy_keys")), "copies")
    copied = F.coalesce(F.array_contains("copy_keys", F.col("key")), F.lit(False)).alias("copied")
    dealt = docs.select("doc_id", whole_text().alias("text")).repartition(index.buckets, "doc_id")
    texts = dealt.join(copies.hint("shuffle_hash"), "doc_id", "left").withColumn("key", _key())
    run = index.add(texts.select("doc_id", "text", "key", copied))
    with bucketed(index.spark):
        compared = stored(index.compared(run), "compared")
        marks = compared.where("mark is not null").select("doc_id", F.array("mark").alias("marks"))
        marks = marks.unionAll(index.verified(run, compared)).unionAll(index.fresh(run).where("repeats is not null").select("doc_id", "repeats"))
        marks = stored(marks.groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
        out = stored(_cut(index.texts(run).join(marks.hint("shuffle_hash"), "doc_id", "left")), "kept")
        index.runs.append(run)
        index.compact()
    discard(compared)
    discard(marks)
    release(index.spark)
    return out


def _key():
    return F.unhex(F.sha2(whole_text(), 256))


def removed(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs, taken into the index in `batches` batches by doc_id.
    Documents that the index holds from earlier calls count as well."""
    own = index is None
    index = index or FingerprintIndex(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = stored(docs.select("doc_id", _key().alias("key")), "ids")
    bounds = ids.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if bounds["a"] is None:
        batches = 1
    cuts = [bounds["a"] + (bounds["b"] - bounds["a"] + 1) * k // batches for k in range(1, batches)]
    parts = []
    for k in range(batches):
        here = F.lit(True)
        if k:
            here = here & (F.col("doc_id") >= cuts[k - 1])
        if k < len(cuts):
            below = F.col("doc_id") < cuts[k]
            here = here & (below if k else below | F.col("doc_id").isNull())
        parts.append(_arrived(docs.where(here), ids.where(here), index))
    if own:
        index.drop()
    discard(ids)
    return reduce(DataFrame.unionAll, parts)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The rows of op10 in DuckDB."""
    return f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
    win as (select doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as s from w, unnest(range(1, len(ws) - {WINDOW - 2})) t(i)),
    least as (select s, min(doc_id) as m from win group by s having count(*) > 1),
    gone as (select distinct win.doc_id, unnest(range(i, i + {WINDOW})) as p from win join least using (s) where win.doc_id > m),
    words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
    kept as (select words.doc_id, string_agg(word, ' ' order by words.p) as t, count(*) as n from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by 1)
    select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from w left join kept on w.doc_id = kept.doc_id"""
