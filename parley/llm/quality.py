"""Quality by co-training: a view of the text and a view of the page's metadata teach each other.

The text view sees shares of character classes, word lengths and repetition, marks on words and lines; the metadata view sees
source, language and the stated length. Each round both are fitted to what they know and score all unlabelled documents in
Spark; where the calibrated probability of one view is beyond `sure`, the document is handed to the other as a pseudo-label.
A view that is never sure hands over nothing, so metadata that say nothing about quality do no harm. At the end each view is
calibrated by a logistic curve on labelled rows that its fit did not see, a last logistic regression over those held-out
scores weighs both, and all documents are scored.

The features of all documents are computed once and kept in the shared folder, so a round reads numbers, not texts. The
fits go on in the driver, on bounded samples of labelled rows: at most `sample` of each label, and at most `handed` of each
pseudo-label that a view is handed in a round, those with the least hash of their numbers. How many documents were handed over
in all is counted over all of them. Only feature rows are collected, never texts, and scoring shuffles nothing.

Defined results: a null or empty text has the features of no text at all and is scored from them; null metadata are a
value of their own; labels that contradict each other count as the higher one, for all rows that repeat their doc_id; a row
without doc_id has no label; without labels of both kinds all documents score 1 and are kept; repeated rows repeat, and
count once in a fit; an empty table gives no rows; `score` replaces a column of its own column's name; other columns pass
through `accepted`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import discard, stored, table
from parley.llm.words import Words, slices

SAMPLE = 3000
ROUNDS = 5
HANDED = 500
SURE = 0.97
KEEP_AT = 0.5
META_SLOTS = 256

# Character classes, by byte.
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*", b"@/\\:;=_~^<>", b"\"'`()[]{}", b"-+")
_GROUP = np.full(256, len(_GROUPS), np.uint8)
for _k, _bytes in enumerate(_GROUPS):
    _GROUP[list(_bytes)] = _k
_GROUP[128:] = len(_GROUPS) + 1
N_GROUPS = len(_GROUPS) + 2
N_FEATURES = 17 + N_GROUPS


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def text_features(words: Words) -> np.ndarray:
    """One row of numbers for each text."""
    n = len(words.count)
    size = np.diff(words.text_at).astype(float)
    per_byte, count = 1 / np.maximum(size, 1), words.count.astype(float)
    per_word = 1 / np.maximum(count, 1)
    group = _GROUP[words.data]
    owner = np.repeat(np.arange(n), np.diff(words.text_at))
    shares = np.bincount(owner * N_GROUPS + group, minlength=n * N_GROUPS).reshape(n, N_GROUPS) * per_byte[:, None]
    length = words.end - words.start
    last = group[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    first = group[words.start] if len(length) else np.zeros(0, np.uint8)
    hashes, text = words.hashes(), words.text_of_word()
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(h)))
    distinct, top = np.zeros(n), np.zeros(n)
    if len(heads):
        distinct = np.bincount(t[heads], minlength=n).astype(float)
        np.maximum.at(top, t[heads], runs)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    columns = [
        np.log1p(size) / 10, np.log1p(count) / 10, (count == 0).astype(float),
        _per_text(length, words.word_at) * per_word / 10, _per_text(length > 20, words.word_at) * per_word,
        _per_text(length == 1, words.word_at) * per_word, distinct * per_word, top * per_word, _per_text(again, words.word_at) * per_word,
        _per_text(last >= 7, words.word_at) * per_word - _per_text(last > len(_GROUPS), words.word_at) * per_word,
        _per_text(last == 7, words.word_at) * per_word, _per_text(last == 9, words.word_at) * per_word,
        _per_text(first == 1, words.word_at) * per_word, _per_text(first >= 8, words.word_at) * per_word - _per_text(first > len(_GROUPS), words.word_at) * per_word,
        shares[:, 4] * size * per_word, shares[:, 5] * size * per_word,
        shares[:, 1] / np.maximum(shares[:, 0] + shares[:, 1], 1e-9),
    ]
    return np.column_stack([*columns, shares])


def meta_slots(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The three one-hot slots of a row's metadata."""
    def slot(kind: str, x) -> int:
        return zlib.crc32(f"{kind}:{x}".encode()) % META_SLOTS

    return slot("source", source), slot("lang", lang), slot("size", None if n_chars is None or n_chars < 0 else int(n_chars).bit_length())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps. The last column of x is the bias, which is not held back."""
    weight = np.ones(len(y)) if weight is None else weight
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - hold * w)
        w += step * min(1.0, 8 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A linear classifier over standardised columns, with a calibration of its score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.clip(np.column_stack([z, np.ones(len(x))]) @ self.weights, -12, 12)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.curve[0] + self.curve[1]


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> View:
    centre, spread = x.mean(axis=0), x.std(axis=0)
    scale, used = np.maximum(spread, 1e-3), np.flatnonzero(spread > 0)
    z = np.clip((x[:, used] - centre[used]) / scale[used], -8, 8)
    weights = np.zeros(x.shape[1] + 1)
    weights[np.append(used, x.shape[1])] = logistic(np.column_stack([z, np.ones(len(x))]), y, weight, l2)
    return View(centre, scale, weights)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, truth: np.ndarray, l2: float) -> tuple[View, np.ndarray]:
    """A view fitted to all rows, calibrated on the true labels by scores from three fits that did not see them; and these
    scores of the rows with true labels, calibrated as well."""
    view = fitted(x, y, weight, l2)
    fold, raw = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        if len(np.unique(y[fold != k])) == 2:
            raw[fold == k] = fitted(x[fold != k], y[fold != k], weight[fold != k], l2).raw(x[fold == k])
    if len(np.unique(y[truth])) == 2:
        view.curve = logistic(np.column_stack([raw[truth], np.ones(truth.sum())]), y[truth], l2=1e-2)
    return view, raw[truth] * view.curve[0] + view.curve[1]


@dataclass
class Rows:
    """Feature rows of both views with their labels."""

    text: np.ndarray
    meta: np.ndarray
    label: np.ndarray

    def of(self, view: int) -> np.ndarray:
        return self.meta if view else self.text

    def join(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(pair) for pair in ((self.text, other.text), (self.meta, other.meta), (self.label, other.label))))


@dataclass
class Model:
    text: View
    meta: View
    blend: np.ndarray  # text logit, metadata logit, bias
    #: For each round and view: how many unlabelled documents it was sure of, of label 1 and 0.
    handed: list[tuple[int, int, int, int]]

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = np.column_stack([self.text.logit(text), self.meta.logit(meta), np.ones(len(text))])
        return sigmoid(both @ self.blend)


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_SLOTS))
    out[np.arange(len(slots))[:, None], slots] = 1
    return out


#: What a round asks: the two views -> for each of them the rows that it is sure of, to be handed to the other, and their number
#: by label.
Handed = list[tuple[Rows, int, int]]


def co_train(given: Rows, ask: Callable[[list[View]], Handed], rounds: int = ROUNDS) -> Model:
    """The two views after at most `rounds` rounds of exchange, and their blend."""
    l2 = (0.3, 3.0)
    nothing = Rows(given.text[:0], given.meta[:0], given.label[:0])
    taught, log = [nothing, nothing], []

    def fit(k: int) -> tuple[View, np.ndarray]:
        rows = given.join(taught[k])
        n = len(given.label)
        weight = np.concatenate([np.ones(n), np.full(len(taught[k].label), 0.5)])
        return calibrated(rows.of(k), rows.label, weight, np.arange(len(weight)) < n, l2[k])

    for turn in range(rounds):
        told = ask([fit(k)[0] for k in (0, 1)])
        log += [(turn, k, ones, zeros) for k, (_, ones, zeros) in enumerate(told)]
        # what a view is sure of now takes the place of what it was sure of before
        new = [told[1][0], told[0][0]]
        same = all(a.text.shape == b.text.shape and (a.text == b.text).all() and (a.label == b.label).all() for a, b in zip(taught, new, strict=True))
        taught = new
        if same:
            break
    (text_view, text_logit), (meta_view, meta_logit) = fit(0), fit(1)
    both = np.column_stack([text_logit, meta_logit, np.ones(len(given.label))])
    return Model(text_view, meta_view, logistic(both, given.label, l2=1.0), log)


_FEATURES = "doc_id long, features array<float>, slots array<int>"


def _columns(part: pa.RecordBatch, names: tuple[str, ...]) -> list[pa.Array]:
    return [part.column(part.schema.get_field_index(name)) for name in names]


def _slots(part: pa.RecordBatch) -> np.ndarray:
    return np.array([meta_slots(*x) for x in zip(*(c.to_pylist() for c in _columns(part, ("source", "lang", "n_chars"))), strict=True)], np.int32).reshape(-1, 3)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, lang, n_chars -> doc_id, features, slots."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                x = text_features(words).astype(np.float32)
                slots = _slots(part)
                columns = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel())) for m in (x, slots)]
                yield pa.RecordBatch.from_arrays([*_columns(part, ("doc_id",)), *columns], names=["doc_id", "features", "slots"])

    named = docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return named.mapInArrow(rows, _FEATURES)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _collected(rows: DataFrame) -> Rows:
    """features, slots, label of a bounded table, in one order whatever the partitions."""
    found = rows.orderBy("h", "features", "slots").select("features", "slots", "label").toArrow()
    if not found.num_rows:
        return Rows(np.zeros((0, N_FEATURES)), np.zeros((0, META_SLOTS)), np.zeros(0))
    features, slots, label = (c.combine_chunks() for c in found.columns)
    return Rows(_matrix(features).astype(float), one_hot(_matrix(slots)), np.asarray(label, float))


def _least(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` different rows (features, slots, label), those with the least hash."""
    return rows.select("features", "slots", "label", F.xxhash64("features", "slots").alias("h")).distinct().orderBy("h", "features", "slots").limit(most)


def sure_of(unlabelled: DataFrame, views: list[View], sure: float) -> DataFrame:
    """Every unlabelled row (features, slots) of which a view is sure: view, label, features, slots."""
    shared = unlabelled.sparkSession.sparkContext.broadcast(views)  # a few hundred numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, slots = (batch.column(batch.schema.get_field_index(c)) for c in ("features", "slots"))
            for k, view in enumerate(shared.value):
                p = sigmoid(view.logit(one_hot(_matrix(slots)) if k else _matrix(features).astype(float)))
                for label in (1, 0):
                    found = np.flatnonzero((p if label else 1 - p) >= sure)
                    taken = [features.take(pa.array(found)), slots.take(pa.array(found))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(np.full(len(found), label, np.int32)), *taken], names=["view", "label", "features", "slots"])

    return unlabelled.select("features", "slots").mapInArrow(rows, "view int, label int, features array<float>, slots array<int>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, handed: int = HANDED, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """Fits the model to docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality)."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    every = stored(featured(docs).join(known, "doc_id", "left").select("features", "slots", "label"), "features")
    given = [_collected(_least(every.where(F.col("label") == k), sample)) for k in (1, 0)]
    if not all(len(x.label) for x in given):
        return None
    # labels take turns, so that each fold holds both
    rows = given[0].join(given[1])
    turn = np.argsort(np.concatenate([np.arange(len(x.label)) / len(x.label) for x in given]), kind="stable")
    rows = Rows(rows.text[turn], rows.meta[turn], rows.label[turn])
    free = every.where("label is null")

    def ask(views: list[View]) -> Handed:
        found = stored(sure_of(free, views, sure), "sure")
        n = {(r["view"], r["label"]): r["n"] for r in found.groupBy("view", "label").agg(F.count("*").alias("n")).collect()}
        out = []
        for k in (0, 1):
            ones, zeros = (_collected(_least(found.where((F.col("view") == k) & (F.col("label") == label)), handed)) for label in (1, 0))
            out.append((ones.join(zeros), n.get((k, 1), 0), n.get((k, 0), 0)))
        discard(found)
        return out

    model = co_train(rows, ask, rounds)
    discard(every)
    return model


def score(docs: DataFrame, model: Model | None, name: str = "quality_score") -> DataFrame:
    """Every row of docs with its score, 0 to 1, as the column `name`."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema.fields)}, `{name}` double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                value = np.ones(part.num_rows)
                if shared.value is not None:
                    # as the features were rounded when they were stored
                    value = shared.value.score(text_features(words).astype(np.float32).astype(float), one_hot(_slots(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, name])

    return docs.mapInArrow(rows, schema)


def accepted(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    name = "_".join(["score", *docs.columns])  # no column of docs is named so
    return score(docs, train(docs, labels), name).where(F.col(name) >= keep_at).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_AT).alias("keep"))
