"""Personal data: exact patterns, and what a linear-chain conditional random field adds to them.

Patterns (kinds email, ip, card, phone) are matched leftmost and without overlap for each kind; a match that fails its
test is dropped. The field labels tokens by their shapes: the classes of their characters, whole and with runs
collapsed, the shapes beside them, lengths and digits. It is trained on the driver from the small labelled table that
`labelled_table` builds, and decoded by Viterbi in numpy batches. A run of equal labels is a span; its kind is one of
the four or `secret` (keys and passwords). A span that overlaps a pattern's match is not added.

The field reads every token that has anything but letters (a mark at its end aside), with its neighbours; a token of
letters alone is never personal data. All of that goes on inside Arrow batches: nothing is shuffled, and a task holds
one slice of a batch.

Defined results: a null or empty text has no spans; a row without doc_id is judged like any other; repeated rows repeat;
an empty table gives no rows; other columns are ignored by `find` and pass through `redact`. Every pattern and test is
linear in the text, so runs of any length (digits, marks, one endless token) are judged whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm import crf
from parley.llm.common import table
from parley.llm.words import Words, slices, span_hashes, utf8

# The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS, "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match within a run of digits would end where that run does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @: linear also in long runs of word characters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            free = end.end()
        else:
            free = max(free, at)  # no match may begin before this @ and reach beyond it
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IP.search(text, at):
        at = m.end()
        parts = (x.lstrip("0") for x in m[0].split("."))  # int() refuses very long numbers
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the patterns' matches, in order."""
    return sorted((start, k, end) for k, find in enumerate(_FINDERS) for start, end in find(text))


# The field.

SHAPES = 1 << 12
# Feature ids: a bias, lengths, digits, then shapes: whole, collapsed, of the token before, of the one after, first bytes;
# at last, which classes a token has, with a coarse length.
BIAS, LENGTH, DIGITS, WHOLE = 0, 1, 25, 50
COLLAPSED, BEFORE, AFTER, HEAD, MAKE = (WHOLE + k * SHAPES for k in range(1, 6))
N_FEATURES = WHOLE + 5 * SHAPES + 64

# Character classes: lower case and longer sequences, upper case, digits; any other byte is a class of its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[128:] = ord("a")
_LETTERS = np.zeros(256, bool)
_LETTERS[[ord("a"), ord("A")]] = True
_END_MARK = np.zeros(256, bool)
_END_MARK[[ord(c) for c in ".,!?;:"]] = True


def _bucket(h: np.ndarray, start: int) -> np.ndarray:
    return (start + (h % np.uint64(SHAPES)).astype(np.int64)).astype(np.int32)


class Windows:
    """The tokens that the field reads, as sequences: what is not letters alone, and its neighbours."""

    def __init__(self, words: Words, around: int = 2):
        kind = _CLASS[words.data]
        letters = np.concatenate([[0], np.cumsum(_LETTERS[kind])])
        size = words.end - words.start
        plain = letters[words.end] - letters[words.start] + _END_MARK[words.data[words.end - 1]] >= size if len(size) else np.zeros(0, bool)
        text = words.text_of_word()
        near = ~plain
        odd = near.copy()
        for k in range(1, around + 1):
            same = text[k:] == text[:-k]
            near[k:] |= odd[:-k] & same
            near[:-k] |= odd[k:] & same
        self.token = np.flatnonzero(near)
        t = self.token
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1] + 1) | (text[t[1:]] != text[t[:-1]])
        self.at = np.append(np.flatnonzero(new), len(t)) if len(t) else np.zeros(1, np.int64)
        self.features = self._features(words, kind, t, new)

    @staticmethod
    def _features(words: Words, kind: np.ndarray, t: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.zeros((len(t), 9), np.int32)
        if not len(t):
            return out
        start, end = words.start[t], words.end[t]
        kept = np.ones(len(kind), bool)
        kept[1:] = kind[1:] != kind[:-1]
        kept[words.start] = True
        place = np.concatenate([[0], np.cumsum(kept)])
        collapsed = span_hashes(kind[kept], place[start], place[end])
        digits = np.concatenate([[0], np.cumsum(kind == ord("9"))])
        before = np.concatenate([[np.uint64(0)], collapsed[:-1]])
        before[new] = 0
        after = np.concatenate([collapsed[1:], [np.uint64(0)]])
        after[np.flatnonzero(new)[1:] - 1] = 0
        out[:, 1] = LENGTH + np.minimum(end - start, 23)
        out[:, 2] = DIGITS + np.minimum(digits[end] - digits[start], 24)
        out[:, 3] = _bucket(span_hashes(kind, start, np.minimum(end, start + 32)), WHOLE)
        out[:, 4] = _bucket(collapsed, COLLAPSED)
        out[:, 5] = _bucket(before, BEFORE)
        out[:, 6] = _bucket(after, AFTER)
        upper, lower = (np.concatenate([[0], np.cumsum(kind == ord(c))]) for c in "Aa")
        n = [x[end] - x[start] for x in (lower, upper, digits)]
        has = sum((x > 0) * (1 << j) for j, x in enumerate(n)) + 8 * (sum(n) < end - start)
        out[:, 8] = MAKE + has * 4 + np.searchsorted([8, 16, 24], end - start, "right")
        out[:, 7] = _bucket(span_hashes(words.data, start, np.minimum(end, start + 4)), HEAD)
        return out


def labelled_table(rows: int = 800, seed: int = 11) -> list[list[tuple[str, int]]]:
    """The small table of labelled tokens: invented sentences with personal data, and with what only looks like it."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    letters = lambda n, pool="abcdefghijklmnopqrstuvwxyz": "".join(pick(pool) for _ in range(n))
    mixed = lambda n: letters(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    word = lambda: letters(int(rng.integers(1, 10)), "abcdefghijklmnopqrstuvwxyzéüñ") + pick(["", "", "", ",", "."])
    octet = lambda: str(rng.integers(0, 256))
    mail = lambda: letters(int(rng.integers(3, 9))) + pick([".", "_", "", "-"]) + pick(["", digits(2), letters(4)])
    host = lambda: letters(int(rng.integers(3, 8))) + pick(["", digits(1), "-" + letters(3)]) + pick([".example", "", "." + letters(5)]) + pick([".com", ".org", ".net", ".de"])
    makers = {
        1: [lambda: mail() + "@" + host(), lambda: mail() + "(at)" + host(), lambda: mail() + "[at]" + host(), lambda: "mailto:" + mail() + "@" + host()],
        2: [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)) + ":" + digits(4), lambda: ":".join(letters(4, "0123456789abcdef") for _ in range(8))],
        3: [lambda: digits(16), lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4))],
        4: [
            lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"+{digits(2)} {digits(3)} {digits(4)} {digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        ],
        5: [
            lambda: "password=" + letters(18, "0123456789abcdef"), lambda: f'token = "{letters(40, "0123456789abcdef")}"', lambda: "AKIA" + mixed(16),
            lambda: "api_key=" + letters(24, "0123456789abcdefghijklmnop"), lambda: "secret: " + letters(32, "0123456789abcdef"), lambda: "sk-" + mixed(24),
            lambda: "ghp_" + mixed(20), lambda: "passwd=" + letters(10),
            lambda: letters(40, "0123456789abcdef"),
        ],
    }
    long = lambda: letters(int(rng.integers(8, 24)), "abcdefghijklmnopqrstuvwxyzéüñ")
    mark = lambda: pick(["%%%", "***", "&&&", "###", "$$$"])
    shout = lambda: letters(int(rng.integers(2, 8))).upper() + "!!"
    decoys = [
        lambda: digits(4), lambda: digits(int(rng.integers(1, 7))), lambda: f"{digits(2)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: "$" + digits(3), lambda: digits(2) + "%", lambda: letters(5) + "%%%", lambda: letters(4) + "***", lambda: letters(6) + ".&&&", lambda: letters(3) + "###", lambda: letters(5) + "$$$", lambda: letters(3) + ",***",
        lambda: long() + mark(), lambda: long().capitalize() + mark(), lambda: long() + pick([",", "."]) + mark(), lambda: long().upper() + "!!", lambda: letters(2) + mark(), lambda: pick("abé") + mark(),
        shout, lambda: letters(4).upper() + ",!!", lambda: letters(4).upper() + ".!!", lambda: "|", lambda: "-", lambda: "=", lambda: letters(4) + "=" + letters(3), lambda: '"' + letters(5) + '"', lambda: letters(3) + "-" + letters(4),
        lambda: "v" + digits(1) + "." + digits(1) + ".", lambda: digits(1) + ".0.", lambda: "BY-NC", lambda: "(" + letters(4) + ")", lambda: letters(5) + "'s", lambda: "version " + digits(1) + ".", lambda: "http://" + letters(8) + "/" + letters(4),
        lambda: letters(4) + "://" + letters(6), lambda: digits(1) + "," + digits(3), lambda: letters(2).upper() + digits(3), lambda: "#" + digits(3), lambda: "[" + letters(5).upper() + "]", lambda: letters(6) + "=" + digits(2),
    ]
    out = []
    for k in range(rows):
        row = [(word(), 0) for _ in range(int(rng.integers(2, 7)))]
        for _ in range(int(rng.integers(1, 4))):
            if k % 2:
                label = int(rng.integers(1, 6))
                row += [(x, label) for x in (pick(makers[label])() + pick(["", "", ".", ","])).split()]
            else:
                # a decoy stands alone or in a row of its kind
                decoy = pick(decoys)
                for _ in range(int(rng.integers(1, 5))):
                    row += [(x, 0) for x in decoy().split()]
            row += [(word(), 0) for _ in range(int(rng.integers(1, 6)))]
        out.append(row)
    return out


@lru_cache(maxsize=1)
def trained() -> crf.Chain:
    """The field, from the labelled table."""
    rows = labelled_table()
    words = Words(*utf8(pa.array([" ".join(x for x, _ in row) for row in rows], pa.large_string())))
    label = np.array([y for row in rows for _, y in row])
    seen = Windows(words)
    return crf.train(seen.features, label[seen.token], seen.at, N_FEATURES, len(LABELS), rounds=150, rate=0.5, l2=1e-5)


_AT = re.compile(r"@|[\[(]at[\])]")
_PARTS = re.compile(r"[0-9a-fA-F]{0,5}[.:][0-9a-fA-F]{0,5}[.:][0-9a-fA-F]{0,5}[.:][0-9a-fA-F]")
_ASSIGNED = re.compile(r"[=:_]")
_LONG = re.compile(r"\w{8}")
_KEY = re.compile(r"\w{16,}")


def plausible(label: int, shown: str) -> bool:
    """What a span of a label must hold to be added. Each test is linear in the span."""
    digits = "".join(c for c in shown if "0" <= c <= "9")
    if label == 1:
        return bool(_AT.search(shown))
    if label == 2:
        return bool(_PARTS.search(shown))
    if label == 3:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if label == 4:
        return 7 <= len(digits) <= 15
    assigned = _ASSIGNED.search(shown)
    if assigned and _LONG.search(shown, assigned.end()):
        return True
    return any(any("0" <= c <= "9" for c in m[0]) for m in _KEY.finditer(shown))


_OUTER = b"\"'`()[]{}<>,;:!?.=#$%&*"


def added_spans(model: crf.Chain, words: Words) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, label, end) of the field's spans, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.count]
    seen = Windows(words)
    if not len(seen.token):
        return out
    label = crf.viterbi(model, crf.scores(model, seen.features), seen.at)
    found = np.flatnonzero(label)
    if not len(found):
        return out
    head = np.zeros(len(label), bool)
    head[seen.at[:-1]] = True
    points = np.cumsum((words.data & 0xC0) != 0x80)
    text_of = np.searchsorted(words.word_at, seen.token[found], "right") - 1
    runs: list[list[int]] = []
    for k, text in zip(found.tolist(), text_of.tolist(), strict=True):
        if runs and runs[-1][1] == k - 1 and label[runs[-1][0]] == label[k] and not head[k]:
            runs[-1][1] = k
        else:
            runs.append([k, k, text])
    for first, last, text in runs:
        start, end = int(words.start[seen.token[first]]), int(words.end[seen.token[last]])
        raw = words.data[start:end].tobytes()
        inner = raw.strip(_OUTER) if label[first] != 4 else raw.rstrip(_OUTER).lstrip(_OUTER.replace(b"(", b""))
        shown = inner.decode("utf-8", "replace")
        if not plausible(int(label[first]), shown):
            continue
        start += raw.index(inner)
        base = int(points[words.text_at[text]]) - 1
        out[text].append((int(points[start]) - 1 - base, int(label[first]), int(points[start + len(inner) - 1]) - base))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_NOTABLE = np.zeros(256, bool)
_NOTABLE[ord("0") : ord("9") + 1] = True
_NOTABLE[ord("@")] = True


def spans_of(model: crf.Chain, words: Words) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[str, int, int]], str]]:
    """For each text: the patterns' matches, all spans (kind, start, end), and the text where it may have any, else empty."""
    notable = np.concatenate([[0], np.cumsum(_NOTABLE[words.data])])
    for k, extra in enumerate(added_spans(model, words)):
        a, b = words.text_at[k], words.text_at[k + 1]
        if notable[a] == notable[b] and not extra:  # no pattern matches without a digit or an @
            yield [], [], ""
            continue
        text = words.data[a:b].tobytes().decode()
        base = base_spans(text)
        new = [(s, y - 1, e) for s, y, e in extra if not any(s < be and bs < e for bs, _, be in base)]
        yield base, [(LABELS[y + 1], s, e) for s, y, e in sorted(base + new)], text


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of each pattern's matches, the digest of these, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a table of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                counts, digests, spans = [], [], []
                for base, every, _ in spans_of(shared.value, words):
                    counts.append([sum(k == j for _, k, _ in base) for j in range(4)] if base else [0] * 4)
                    digests.append(hashlib.sha256(_joined([(KINDS[k], s, e) for s, k, e in base]).encode()).hexdigest())
                    spans.append(_joined(every))
                numbers = np.array(counts, np.int64).reshape(-1, 4)
                columns = [part.column(part.schema.get_field_index("doc_id")), *(pa.array(numbers[:, j]) for j in range(4)), pa.array(digests), pa.array(spans)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, FOUND)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with spans of personal data replaced in `text`; texts without any stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for part, words in slices(batch):
                changed = {k: redacted_text(text, every) for k, (_, every, text) in enumerate(spans_of(shared.value, words)) if every}
                if changed:
                    texts = part.column(place).to_pylist()
                    for k, text in changed.items():
                        texts[k] = text
                    part = part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))
                yield part

    return docs.mapInArrow(rows, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
