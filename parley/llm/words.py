"""Words and word windows of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D (those bytes never occur inside a longer UTF-8
sequence). Hashes are polynomial and then mixed, so a batch costs a few array passes and no Python object for each word. Words are hashed over their bytes modulo the prime 2**31 - 1 at two random bases (modulo a power of two some long
words with a regular build would hash alike, whatever the base); `hashes(1)` has two other bases. Runs of a few words are hashed over
the mixed hashes of these, modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power_table(base: np.uint64, inverse: bool, n: int) -> np.ndarray:
    """base**k (or its inverse**k) for k below n, modulo 2**64."""
    key = (int(base), inverse)
    if key not in _powers or len(_powers[key]) < n:
        step = np.uint64(pow(int(base), -1, 1 << 64)) if inverse else base
        out = np.full(max(n, 1 << 16), step, np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of any spans of one array of values, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BYTE_BASE):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * _power_table(base, False, n), out=self.prefix[1:])
        self.back = _power_table(base, True, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[ends] - self.prefix[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span."""
    return Spans(values, base).hashes(starts, ends)


# Random bases below the prime, two for each word hash.
_PRIME, _PRIME_BASES = np.uint64((1 << 31) - 1), ((1_368_945_233, 744_019_851), (1_905_216_047, 1_127_730_419))


_CHUNK = 1 << 18


@lru_cache(maxsize=4)
def _prime_powers(base: int, size: int) -> np.ndarray:
    """base**k modulo the prime for k below 2**size."""
    out = np.ones(1, np.uint64)
    while len(out) < 1 << size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_PRIME))) % _PRIME])
    return out


def prime_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the spans, which are not empty, from its values modulo a prime at two bases.

    About _CHUNK bytes are taken at once; the powers that are kept reach as far as the longest of the spans.
    """
    length = (ends - starts).astype(np.int64)
    out = mixed(length.astype(np.uint64))
    if not len(out):
        return out
    before = np.concatenate([[0], np.cumsum(length)])
    size = max(10, int(length.max()).bit_length())
    k = 0
    while k < len(length):
        to = max(k + 1, int(np.searchsorted(before, before[k] + _CHUNK, "right")) - 1)
        own = length[k:to]
        first = before[k:to] - before[k]
        offset = np.arange(before[to] - before[k]) - np.repeat(first, own)
        value = data[offset + np.repeat(starts[k:to], own)].astype(np.uint64) + np.uint64(1)
        for base in _PRIME_BASES[which]:
            total = np.add.reduceat(value * _prime_powers(base, size)[offset] % _PRIME, first) % _PRIME
            out[k:to] = mixed(out[k:to] ^ total) + np.uint64(which)
        k = to
    return out


class Words:
    """The words of a run of texts.

    data: all bytes; text_at: byte offset of each text (one more than texts); start, end: byte span of each word;
    word_at: index of each text's first word (one more than texts).
    """

    def __init__(self, data: np.ndarray, text_at: np.ndarray):
        self.data, self.text_at = data, text_at
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cut = text_at[:-1][text_at[:-1] < len(data)]
        before[cut] = False
        first = inside & ~before
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        last_byte = text_at[1:][text_at[1:] > 0] - 1
        after[last_byte] = False
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.word_at = np.searchsorted(self.start, text_at)
        self.count = np.diff(self.word_at)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word; two that are independent."""
        return prime_hashes(self.data, self.start, self.end, which)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def passage(self, first: int, last: int) -> str:
        """The text from word `first` to word `last`, that one included."""
        return self.data[self.start[first] : self.end[last]].tobytes().decode("utf-8", "replace")


# Byte classes: letters are kept in lower case, bytes of longer sequences count as letters, the rest parts words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_LETTER[ord("'")] = True
_LETTER_OR_DIGIT = _LETTER.copy()
_LETTER_OR_DIGIT[ord("0") : ord("9") + 1] = True


class LetterRuns:
    """The letter runs of a run of texts, in lower case; with digits, digits count as letters.

    start, end: byte span of each; at: index of each text's first (one more than texts); hash: of its lower case.
    """

    def __init__(self, data: np.ndarray, text_at: np.ndarray, digits: bool = False):
        letter = _LETTER_OR_DIGIT if digits else _LETTER
        low = _LOWER[data]
        upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        low[upper] += 32  # the capital letters of U+00C0 to U+00DE
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = letter[low]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        heads = text_at[:-1][text_at[:-1] < len(low)]
        first[heads] |= inside[1:-1][heads]
        tails = text_at[1:][text_at[1:] > 0] - 1
        last[tails] |= inside[1:-1][tails]
        self.low = low
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, text_at)
        self.spans = Spans(low)
        self.hash = self.spans.hashes(self.start, self.end)

    def text_of_token(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def windows(word_hashes: np.ndarray, word_at: np.ndarray, n: int, base: np.uint64 = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n consecutive words of one text, and the index of each window's first word."""
    total = len(word_hashes)
    ok = np.ones(max(total - n + 1, 0), bool)
    for k in range(1, n):  # no window reaches over the end of its text
        at = word_at[1:-1] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    first = np.flatnonzero(ok)
    return span_hashes(word_hashes, first, first + n, base), first


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in runs of rows with about `most` bytes of text each (one text at least), with their words."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x
