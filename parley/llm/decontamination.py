"""Benchmark decontamination: rare n-gram seeds join passages to test items, and Smith-Waterman alignment scores them.

Tokens are runs of letters and digits in lower case, so case, punctuation and spacing don't matter. The n-grams of the
test items are counted over all documents; those that are rare for their item are its seeds: no more than COMMON times
as many documents hold them as hold the item's middling n-gram (and COMMON more), so an item that is itself all over
the documents keeps its seeds, and what merely is common speech is none. A seed has SEED tokens. A passage that holds a NEEDED-th
of the seeds of an item, and two different ones at least, at like offsets, is aligned with the whole item by Smith-Waterman (2 for
a match, -1 for a change or a gap); its score over the greatest possible one is the similarity, and pairs from `at` up are returned.

Why that finds them: a passage of similarity 0.5 has at most L/3 of the L tokens of its item changed or left out, so at least L/3 - 1 of
its L - 1 pairs of neighbours are whole, wherever the changes are. Words that are put in break one pair each, and one in nearly every gap
leaves a similarity of 0.5 as well; so in a passage two tokens with one between them are looked up as a pair, too.
tests/llm/test_decontamination.py measures recall against the alignment of everything.

The test items are the stated query set. They are taken in blocks of bounded size (about BLOCK tokens), and each block,
broadcast with its seeds, meets all documents in two passes of Arrow batches: one counts, one joins and aligns. Only
counts of seeds are shuffled, added up before; a passage that a third of the documents share is aligned where it
stands, and a pair appears once, from the task that holds the document.

`clean` judges each row where it stands and moves no text.

Defined results: null or empty texts and items have no tokens and pair with nothing; an item of one token is sought as such;
items with equal tokens each get their pairs; a row without doc_id is judged by its text like any other; of passages with one
score the first counts; rows of docs that repeat give repeated pairs; an empty table on either side gives no pairs; other
columns are ignored, and pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import table
from parley.llm.words import WORD_BASE, LetterRuns, mixed, slices, utf8, windows

SEED = 2
NEEDED = 8
COMMON = 10
AT = 0.5
BLOCK = 1 << 20
MATCH, CHANGE, GAP = 2, -1, -1
_SIEVE_BITS = 18


@dataclass
class Items:
    """A block of test items as tokens."""

    ids: np.ndarray
    tokens: np.ndarray  # hashes, flat
    at: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Items:
        runs = LetterRuns(*utf8(pa.array(texts, pa.large_string())), digits=True)
        return cls(np.array(ids, np.int64), runs.hash, runs.at)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, hashes, items, places) of the n-grams; the length is the one that seeds of the item have."""
        length = np.minimum(np.diff(self.at), SEED)
        for n in range(1, SEED + 1):
            h, first = windows(self.tokens, self.at, n)
            item = np.searchsorted(self.at, first, "right") - 1
            good = length[item] == n
            if good.any():
                yield n, h[good], item[good], first[good] - self.at[item[good]]


@dataclass
class Seeds:
    """Seeds of one length, sorted by hash; a seed of several items has several rows."""

    n: int
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, n: int, h: np.ndarray, item: np.ndarray, place: np.ndarray) -> Seeds:
        order = np.argsort(h, kind="stable")
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[h & np.uint64((1 << _SIEVE_BITS) - 1)] = True
        return cls(n, h[order], item[order], place[order], sieve)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices into h that are seeds, and the range of rows of each."""
        maybe = np.flatnonzero(self.sieve[h & np.uint64((1 << _SIEVE_BITS) - 1)])
        low = np.searchsorted(self.hash, h[maybe], "left")
        high = np.searchsorted(self.hash, h[maybe], "right")
        real = high > low
        return maybe[real], low[real], high[real]


def rare_seeds(items: Items, frequency: dict[int, int]) -> list[Seeds]:
    """The n-grams of each item that are rare for it."""
    out = []
    for n, h, item, place in items.grams():
        documents = np.array([frequency.get(int(x), 0) for x in h.view(np.int64)])
        heads = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        middling = np.array([np.median(x) for x in np.split(documents, heads[1:])])
        rare = documents <= COMMON * (np.repeat(middling, np.diff(np.append(heads, len(item)))) + 1)
        out.append(Seeds.of(n, h[rare], item[rare], place[rare]))
    return out


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman for each pair: the best score, and the first and last passage token of that alignment."""
    n, wide, long = len(passages), max(map(len, passages)), max(map(len, items))
    p = np.zeros((n, wide), np.uint64)
    q = np.zeros((n, long), np.uint64)
    p_in, q_in = np.zeros((n, wide), bool), np.zeros((n, long), bool)
    for k, (x, y) in enumerate(zip(passages, items, strict=True)):
        p[k, : len(x)], p_in[k, : len(x)], q[k, : len(y)], q_in[k, : len(y)] = x, True, y, True
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    # cell (i, j) on diagonal d = i + j, stored at j + 1; begin: passage token where the alignment of the cell began
    before2 = np.zeros((n, long + 1), np.int32)
    before = np.zeros((n, long + 1), np.int32)
    begin2 = np.zeros((n, long + 1), np.int32)
    begin = np.zeros((n, long + 1), np.int32)
    rows = np.arange(n)
    for d in range(wide + long - 1):
        a, b = max(0, d - wide + 1), min(long - 1, d)
        j = np.arange(a, b + 1)
        i = d - j
        same = (p[:, i] == q[:, j]) & p_in[:, i] & q_in[:, j]
        inside = p_in[:, i] & q_in[:, j]
        diagonal = before2[:, j] + np.where(same, MATCH, CHANGE)
        up, left = before[:, j + 1] + GAP, before[:, j] + GAP
        cell = np.maximum(np.maximum(diagonal, 0), np.maximum(up, left))
        came = np.where(cell == diagonal, np.where(before2[:, j] > 0, begin2[:, j], i), np.where(cell == up, begin[:, j + 1], begin[:, j]))
        cell = np.where(inside, cell, 0)
        now, now_begin = np.zeros_like(before), np.zeros_like(begin)
        now[:, j + 1], now_begin[:, j + 1] = cell, came
        top = cell.argmax(axis=1)
        better = cell[rows, top] > best
        best[better], first[better], last[better] = cell[rows, top][better], came[rows, top][better], i[top][better]
        before2, begin2, before, begin = before, begin, now, now_begin
    return best, first, last


def parted(runs: LetterRuns) -> tuple[np.ndarray, np.ndarray]:
    """As `windows` of two, but of tokens between which another one stands."""
    text = runs.text_of_token()
    first = np.flatnonzero(text[2:] == text[:-2])
    return mixed(runs.hash[first] + runs.hash[first + 2] * WORD_BASE + np.uint64(2)), first


def candidates(runs: LetterRuns, seeds: list[Seeds], items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, first token, token after the last) of the passages that hold a NEEDED-th of the seeds of an item, two different
    ones at least (or the only one it has), at like offsets."""
    found = []
    for s, h, first in [(s, *x) for s in seeds for x in ([windows(runs.hash, runs.at, s.n)] + [parted(runs)] * (s.n == 2))]:
        at, low, high = s.hits(h)
        if len(at):
            each = high - low
            row = np.repeat(low - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            token = np.repeat(first[at], each)
            text = np.searchsorted(runs.at, token, "right") - 1
            found.append((text, s.item[row], token - s.place[row], s.place[row]))
    if not found:
        return []
    text, item, offset, place = (np.concatenate(x) for x in zip(*found, strict=True))
    n_seeds = np.zeros(len(items.ids), np.int64)
    for s in seeds:
        n_seeds += np.bincount(s.item, minlength=len(n_seeds))
    size = np.diff(items.at)
    order = np.lexsort((offset, item, text))
    text, item, offset, place = text[order], item[order], offset[order], place[order]
    near = np.ones(len(text), bool)  # begins a new group: another pair, or an offset that is far from the one before
    near[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (offset[1:] - offset[:-1] > np.maximum(4, size[item[1:]] // 4))
    heads = np.flatnonzero(near)
    group = np.cumsum(near) - 1
    pairs = np.unique(np.stack([group, place], axis=1), axis=0)
    different = np.bincount(pairs[:, 0], minlength=len(heads))
    low, high = offset[heads], np.maximum.reduceat(offset, heads)
    out = []
    needed = np.minimum(np.maximum(2, n_seeds // NEEDED), n_seeds)
    for k in np.flatnonzero(different >= needed[item[heads]]):
        t, j = int(text[heads[k]]), int(item[heads[k]])
        margin = int(size[j]) // 3 + 2
        out.append((t, j, max(int(runs.at[t]), int(low[k]) - margin), min(int(runs.at[t + 1]), int(high[k]) + int(size[j]) + margin)))
    return out


def aligned(runs: LetterRuns, seeds: list[Seeds], items: Items, at: float, most: int = 4096) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first token, last token) of the best passage of each pair with a similarity of `at` or more."""
    todo = candidates(runs, seeds, items)
    todo.sort(key=lambda x: x[3] - x[2])  # like sizes are padded together
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    k = 0
    while k < len(todo):
        step = max(1, min(most, (1 << 22) // max(1, todo[min(k + 512, len(todo) - 1)][3] - todo[min(k + 512, len(todo) - 1)][2]) // 16))
        part = todo[k : k + step]
        score, first, last = align([runs.hash[a:b] for _, _, a, b in part], [items.tokens[items.at[j] : items.at[j + 1]] for _, j, _, _ in part])
        for (t, j, a, _), x, f, e in zip(part, score.tolist(), first.tolist(), last.tolist(), strict=True):
            share = x / (MATCH * int(items.at[j + 1] - items.at[j]))
            if share >= at and share > best.get((t, j), (0.0,))[0]:
                best[t, j] = (share, a + f, a + e)
        k += step
    for (t, j), (share, f, e) in sorted(best.items()):
        yield t, j, share, f, e


def frequencies(docs: DataFrame, items: Items) -> dict[int, int]:
    """How many documents hold each n-gram of the items. At most one number for each n-gram of the block comes back."""
    grams = [Seeds.of(n, h, item, place) for n, h, item, place in items.grams()]
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for _, words in slices(batch):
                runs = LetterRuns(words.data, words.text_at, digits=True)
                for s in shared.value:
                    h, first = windows(runs.hash, runs.at, s.n)
                    hit, _, _ = s.hits(h)
                    text = np.searchsorted(runs.at, first[hit], "right") - 1
                    if len(hit):
                        pairs = np.unique(np.stack([h[hit], text.astype(np.uint64)], axis=1), axis=0)
                        for x, n in zip(*(y.tolist() for y in np.unique(pairs[:, 0].view(np.int64), return_counts=True)), strict=True):
                            total[x] = total.get(x, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


PAIRS = "doc_id long, item_id long, similarity double, passage string"


def pairs_of_block(docs: DataFrame, items: Items, at: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(items, frequencies(docs, items))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds = shared.value
        for batch in batches:
            for part, words in slices(batch):
                runs = LetterRuns(words.data, words.text_at, digits=True)
                found = list(aligned(runs, seeds, block, at))
                if found:
                    ids = part.column(part.schema.get_field_index("doc_id")).take(pa.array([x[0] for x in found]))
                    texts = [words.data[runs.start[f] : runs.end[e]].tobytes().decode("utf-8", "replace") for *_, f, e in found]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([int(block.ids[x[1]]) for x in found]), pa.array([x[2] for x in found]), pa.array(texts)],
                        names=["doc_id", "item_id", "similarity", "passage"],
                    )

    return docs.select("doc_id", "text").mapInArrow(rows, PAIRS)


def without_block(docs: DataFrame, items: Items, at: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(items, frequencies(docs, items))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds = shared.value
        for batch in batches:
            for part, words in slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in aligned(LetterRuns(words.data, words.text_at, digits=True), seeds, block, at)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)


def blocks_of(items: DataFrame, block: int) -> Iterator[Items]:
    """The items in blocks of about `block` tokens."""
    sized = items.where("text is not null and text != ''").select("item_id", "text")
    tokens = sized.agg(F.sum(F.length("text"))).first()[0] or 0  # a text has fewer tokens than half its characters, and one
    n = max(1, -(-tokens // (2 * block)))
    for k in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        part = Items.of([-1 if r["item_id"] is None else r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(part.tokens):
            yield part


def contaminated(docs: DataFrame, items: DataFrame, at: float = AT, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, similarity, passage: the pairs of a document and a test item that it holds a copy of (item -1: no id)."""
    pairs = [pairs_of_block(docs, part, at) for part in blocks_of(items, block)]
    return reduce(DataFrame.unionAll, pairs) if pairs else docs.sparkSession.createDataFrame([], PAIRS)


def clean(docs: DataFrame, items: DataFrame, at: float = AT, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no copy of a test item."""
    out = docs
    for part in blocks_of(items, block):
        out = without_block(out, part, at)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
