"""Steps that ask a language model, through a client that the caller passes: a function from a prompt to a reply.

Each batch is one request inside a task; what comes back is checked against the text, and a reply that fails the check
counts as none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.bundle import nests_quantifiers

Client = Callable[[str], str]
#: Words that a reply may propose; they are broadcast to the texts.
MOST_PROPOSED = 2000


def chunk_text(text: str, most: int = 1500) -> list[str]:
    """Pieces of at most `most` characters, cut at sentence ends; longer sentences are cut hard. Joined they are the text."""
    out: list[str] = []
    for sentence in re.findall(r"[^。！？.!?\n]*(?:[。！？.!?\n]+|\Z)", text):
        while sentence:
            room = most - len(out[-1]) if out else 0
            if out and len(sentence) <= room:
                out[-1] += sentence
                break
            out.append(sentence[:most])
            sentence = sentence[most:]
    return out


def json_array(reply: str) -> list[str] | None:
    """The first JSON array of strings in a reply, which may stand among other text."""
    for m in re.finditer(r"\[", reply):
        try:
            found, _ = json.JSONDecoder().raw_decode(reply[m.start() :])
        except ValueError:
            continue
        if isinstance(found, list) and all(isinstance(x, str) for x in found):
            return found
    return None


def matches_source(tokens: list[str], text: str) -> bool:
    """Whether tokens are the text, white space aside."""
    squeeze = lambda s: re.sub(r"\s+", "", s)
    return squeeze("".join(tokens)) == squeeze(text)


def segment(texts: DataFrame, client: Client, key: str = "id") -> DataFrame:
    """key, tokens, failed: tokens by the model, chunk by chunk; a chunk that fails the check gives its words as they stand."""

    def one(text: str) -> tuple[list[str], int]:
        out, failed = [], 0
        for part in chunk_text(text):
            found = json_array(client(part))
            if found is None or not matches_source(found, part):
                found, failed = part.split(), failed + 1
            out += [t for t in found if t.strip()]
        return out, failed

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.list_(pa.string())), pa.array([n for _, n in done], pa.int32())], names=[key, "tokens", "failed"])

    return texts.select(key, "text").mapInArrow(rows, f"{key} {dict(texts.dtypes)[key]}, tokens array<string>, failed int")


def label_kinds(words: DataFrame, client: Client, kinds: list[str], batch: int = 200) -> DataFrame:
    """word, kind: the model's kind of each word, where it is one of `kinds` and the word was asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            asked = part.column(0).to_pylist()
            for k in range(0, len(asked), batch):
                some = asked[k : k + batch]
                try:
                    reply = json.loads(client(json.dumps({"kinds": kinds, "words": some}, ensure_ascii=False)))
                except ValueError:
                    reply = {}
                found = [(w, reply[w]) for w in some if isinstance(reply, dict) and reply.get(w) in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["word", "kind"])

    return words.select("word").mapInArrow(rows, "word string, kind string")


def curated(texts: DataFrame, proposed: DataFrame, most_chars: int = 10) -> DataFrame:
    """word, n: proposed words that stand in the texts as they are, with their uses. `proposed` is one reply's list."""
    good = proposed.where((F.length("word") <= most_chars) & ~F.col("word").rlike(r"[\p{P}]")).distinct()
    if good.limit(MOST_PROPOSED + 1).count() > MOST_PROPOSED:
        raise ValueError(f"one reply proposes no more than {MOST_PROPOSED} words")
    held = texts.join(F.broadcast(good), F.col("text").contains(F.col("word")))
    uses = (F.length("text") - F.length(F.replace("text", F.col("word"), F.lit("")))) / F.length("word")
    return held.groupBy("word").agg(F.sum(uses.cast("long")).alias("n"))


def worthwhile_rule(pattern: str, samples: list[str], most: float = 0.7) -> bool:
    """Whether a proposed cleaning rule takes something out of the samples, and never more than `most` of one."""
    if nests_quantifiers(pattern):
        return False
    try:
        left = [re.sub(pattern, "", s) for s in samples]
    except re.error:
        return False
    return any(a != s for a, s in zip(left, samples, strict=True)) and all(len(a) >= (1 - most) * len(s) for a, s in zip(left, samples, strict=True))
