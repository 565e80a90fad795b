"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labelled tokens. Labels are of documents, so tokens get theirs from them: the words that toxic documents hold many times
as often as clean ones, and the stems that recur there with several endings, are the toxic tokens of toxic documents. Labelled
near copies count once (by their least 5-word shingle), so a phrase that one group of copies shares is no such word, and
neither is one that a few wrongly labelled documents happen to share.

The field has a clean and a toxic label. A token's features are its word (of the fitted vocabulary), its stems and last
letters, its length and the words beside it. Forward-backward gives each token's probability of being toxic; a logistic
curve over the greatest and the summed probability of a document, fitted to the same labels, gives its score.

The field is fitted on the driver to a bounded sample: at most `sample` toxic and `sample` clean labelled documents, those
with the least hash of their id, and no more of them than have SAMPLE_BYTES of text together; of rows that repeat an id the
one with the least digest. Its vocabulary, a bound of the model and not of what is scored, is every word with a mark and the
FREQUENT most frequent ones of the sample; other words are told by their stems and last letters. Everything else runs in Arrow
batches and shuffles nothing.

Defined results: a null or empty text has no tokens and gets the score of a document without toxic tokens; a row without
doc_id is scored like any other, and its held_out is null; repeated rows repeat; labels that contradict each other count as
the higher one; documents without label are scored like all; of equally frequent words the one with the lesser hash is in the
vocabulary; where no labelled toxic row can be learned from, all score 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import crf
from parley.llm.common import discard, stored, table, whole_text
from parley.llm.words import LetterRuns, mixed, slices, utf8, windows

SAMPLE, SAMPLE_BYTES = 500, 48 << 20
FREQUENT = 2000
TRAIN_RUN = 64  # items of a training sequence; longer texts are cut into several
TOXIC_AT = 0.3
BUCKETS = 1 << 14
STEMS = (4, 5, 6, 7, 8)  # lengths in bytes
# Feature ids: a bias, lengths, last letters and stems, then three blocks of vocabulary words (this, before, after).
LENGTHS, AFFIXES = 1, 17
VOCABULARY = AFFIXES + (1 + len(STEMS)) * BUCKETS


class Tokens(LetterRuns):
    """The letter runs of a run of texts, in lower case, with the field's features."""

    def stem(self, k: int) -> np.ndarray:
        """The hash of each token's first k bytes; 0 for shorter tokens."""
        return np.where(self.end - self.start >= k, self.spans.hashes(self.start, np.minimum(self.start + k, self.end)), np.uint64(0))

    def features(self, vocabulary: np.ndarray) -> np.ndarray:
        """Feature ids, 6 and one for each stem length, of each token. vocabulary: sorted hashes."""
        size = self.end - self.start
        n, v = len(size), len(vocabulary) + 1
        out = np.zeros((n, 6 + len(STEMS)), np.int32)
        if not n:
            return out
        out[:, 1] = LENGTHS + np.minimum(size, 15)
        out[:, 2] = AFFIXES + (self.spans.hashes(np.maximum(self.start, self.end - 4), self.end) % np.uint64(BUCKETS)).astype(np.int32)
        for j, k in enumerate(STEMS):
            out[:, 6 + j] = AFFIXES + (1 + j) * BUCKETS + (self.stem(k) % np.uint64(BUCKETS)).astype(np.int32)
        known = np.zeros(n, np.int32)
        if len(vocabulary):
            place = np.minimum(np.searchsorted(vocabulary, self.hash), len(vocabulary) - 1)
            known = np.where(vocabulary[place] == self.hash, place + 1, 0).astype(np.int32)
        heads = self.at[:-1][np.diff(self.at) > 0]
        before = np.concatenate([[0], known[:-1]])
        before[heads] = 0
        after = np.concatenate([known[1:], [0]])
        after[heads[heads > 0] - 1] = 0
        out[:, 3] = VOCABULARY + known
        out[:, 4] = VOCABULARY + v + before
        out[:, 5] = VOCABULARY + 2 * v + after
        return out


def gauge(greatest: np.ndarray, summed: np.ndarray) -> np.ndarray:
    """A bias, the greatest probability of a text, and its sum in three parts: up to 1, from 1 to 2, above."""
    return np.stack([np.ones(len(summed)), greatest, np.minimum(summed, 1), np.clip(summed - 1, 0, 1), np.clip(summed - 2, 0, 4)], axis=1)


@dataclass
class Model:
    vocabulary: np.ndarray
    chain: crf.Chain
    curve: np.ndarray  # weights of gauge()

    def score(self, greatest: np.ndarray, summed: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(gauge(greatest, summed) @ self.curve)))


def _marks(keys: np.ndarray, text: np.ndarray, toxic: np.ndarray, floor: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, text) pairs that each occur once: the keys that are `ratio` times as frequent in toxic texts as in clean
    ones and that `floor` toxic texts hold, with their number of toxic texts."""
    found, key = np.unique(keys, return_inverse=True)
    in_toxic = np.bincount(key, toxic[text], len(found))
    in_clean = np.bincount(key, 1 - toxic[text], len(found))
    n_toxic, n_clean = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    pure = in_toxic / n_toxic >= ratio * (in_clean + 0.5) / n_clean
    pure |= (in_clean == 0) & (in_toxic >= 0.1 * n_toxic)  # few clean texts
    good = pure & (in_toxic >= floor)
    return found[good], in_toxic[good]


def telling(tokens: Tokens, toxic: np.ndarray, share: float = 0.1, ratio: float = 20.0) -> np.ndarray:
    """For each token: whether its word, or a stem that recurs with several endings in a text, marks toxic texts.

    A mark is `ratio` times as frequent in toxic texts as in clean ones, and at least `share` as many toxic texts hold
    it as hold the foremost mark.
    """
    text, n = tokens.text_of_token(), max(1, len(toxic))
    words, word = np.unique(tokens.hash, return_inverse=True)
    pairs = np.unique(word.astype(np.int64) * n + text)
    named, support = _marks(words[pairs // n], pairs % n, toxic, 2, ratio)
    most = support.max(initial=0.0)
    stems = []
    for k in STEMS:
        stem = tokens.stem(k)
        stem_at, stem_of = np.unique(stem, return_inverse=True)
        of_word = np.zeros(len(words), np.int64)
        of_word[word] = stem_of
        key, twice = np.unique(of_word[pairs // n] * n + pairs % n, return_counts=True)
        key = key[(twice >= 2) & (stem_at[key // n] != 0)]
        stems.append((stem, *_marks(stem_at[key // n], key % n, toxic, 4, ratio)))
        most = max(most, stems[-1][2].max(initial=0.0))
    floor = share * most
    out = np.isin(tokens.hash, named[support >= floor])
    for stem, marked, support in stems:
        out |= np.isin(stem, marked[support >= floor])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - l2 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0) -> Model | None:
    """The field and the curve from labelled texts. None where nothing tells toxic texts."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    data, text_at = utf8(pa.array(texts, pa.large_string()))
    tokens = Tokens(data, text_at)
    # one text for each least shingle stands for its near copies
    shingle, first = windows(tokens.hash, tokens.at, 5)
    least = mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(1))
    owner = np.searchsorted(tokens.at, first, "right") - 1
    if len(owner):
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least[owner[heads]] = np.minimum.reduceat(shingle, heads)
    _, kept = np.unique(np.stack([least, toxic.astype(np.uint64)], axis=1), axis=0, return_index=True)
    kept = np.sort(kept)
    texts, toxic = [texts[k] for k in kept], toxic[kept]
    data, text_at = utf8(pa.array(texts, pa.large_string()))
    tokens = Tokens(data, text_at)
    marked = telling(tokens, toxic)
    label = (marked & (toxic[tokens.text_of_token()] == 1)).astype(np.int64)
    if not label.any():
        return None
    # the vocabulary: words with a mark, and those that are frequent enough to learn contexts from
    words, n = np.unique(tokens.hash, return_counts=True)
    frequent = words[np.argsort(-n, kind="stable")[:FREQUENT]]
    words, n = np.unique(tokens.hash[marked], return_counts=True)
    vocabulary = np.unique(np.concatenate([words[n >= 2], frequent]))
    features = tokens.features(vocabulary)
    runs = crf.Segments(tokens.at, TRAIN_RUN)
    chain = crf.train(features, label, np.append(runs.first, len(label)), VOCABULARY + 3 * (len(vocabulary) + 1), 2, rounds=30, rate=0.6)
    greatest, summed = gathered(chain, features, tokens.at)
    curve = logistic(gauge(greatest, summed), toxic.astype(float), np.where(toxic == 1, 1.0, clean_weight))
    return Model(vocabulary, chain, curve)


def gathered(chain: crf.Chain, features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = crf.marginals(chain, crf.scores(chain, features), at)[:, 1]
    return per_text(p, at)


def per_text(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the summed probability of each text."""
    n = np.diff(at)
    greatest, summed = np.zeros(len(n)), np.zeros(len(n))
    full = np.flatnonzero(n > 0)
    if len(full):
        greatest[full] = np.maximum.reduceat(p, at[:-1][full])
        summed[full] = np.add.reduceat(p, at[:-1][full])
    return greatest, summed


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the sample, and how many clean rows one sampled clean row stands for, against toxic ones.

    Ids and lengths are joined and picked first, by the hash of the id; only the picked rows' texts are read after that. Of rows with
    one id the shortest text counts, then the one with the least digest.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    eligible = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & (whole_text() != ""))
    sizes = eligible.select("doc_id", F.octet_length("text").alias("size"))
    rows = stored(sizes.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min("size").alias("size")), "labelled")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = {k: rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "size").collect() for k in (1, 0)}
    of, held = {}, 0
    for turn in range(sample):  # toxic and clean ones in turn, as far as their texts have room
        for k in (1, 0):
            if turn < len(picked[k]) and held + picked[k][turn]["size"] <= sample_bytes:
                of[picked[k][turn]["doc_id"]] = k
                held += picked[k][turn]["size"]
    if not of:
        return [], np.zeros(0, np.int64), 1.0
    texts = docs.where(F.col("doc_id").isin(list(of)) & (whole_text() != ""))  # at most 2 * sample ids
    least = F.min(F.struct(F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest"), "text"))
    found = texts.groupBy("doc_id").agg(least.alias("row")).select("doc_id", "row.text").orderBy("doc_id").collect()
    discard(rows)
    n_picked = [sum(v == k for v in of.values()) for k in (1, 0)]
    ratios = [counts.get(k, 0) / max(1, n) for k, n in zip((1, 0), n_picked, strict=True)]
    return [r["text"] for r in found], np.array([of[r["doc_id"]] for r in found], np.int64), ratios[1] / (ratios[0] or 1.0)


SCORE_COLUMNS = "doc_id long, score double, n_toxic_tokens long, offending array<struct<start: int, end: int>>"


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and the toxic tokens with their code-point offsets."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: the feature table has a fixed size
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, words in slices(batch):
                n = part.num_rows
                score, found, spans = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
                if m is not None:
                    tokens = Tokens(words.data, words.text_at)
                    p = crf.marginals(m.chain, crf.scores(m.chain, tokens.features(m.vocabulary)), tokens.at)[:, 1]
                    score = m.score(*per_text(p, tokens.at))
                    hits = np.flatnonzero(p >= 0.5)
                    owner = np.searchsorted(tokens.at, hits, "right") - 1
                    found = np.bincount(owner, minlength=n).astype(np.int64)
                    points = np.cumsum((words.data & 0xC0) != 0x80)  # code points up to each byte
                    for k, i in zip(hits.tolist(), owner.tolist(), strict=True):
                        base = points[words.text_at[i]] - 1
                        spans[i].append({"start": int(points[tokens.start[k]] - 1 - base), "end": int(points[tokens.end[k] - 1] - base)})
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(score), pa.array(found), pa.array(spans, span)],
                    names=["doc_id", "score", "n_toxic_tokens", "offending"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, SCORE_COLUMNS)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_texts(docs, model)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        "n_toxic_tokens",
        "offending",
    )
