"""Word tables as files and links."""

from __future__ import annotations

import base64
import json
import re
import zlib
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_INFLATED, MOST_WORDS, LONGEST_URL = 2 << 20, 2000, 279
LADDER = (120, 80, 60, 40, 30, 20, 10, 5)


def csv_lines(words: DataFrame) -> DataFrame:
    """word, n, kind, priority -> the lines of the CSV export, without the head."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    source = F.when(F.col("priority"), "priority").otherwise("tokenizer")
    return words.select(F.concat_ws(",", quoted("word"), F.col("n").cast("string"), quoted("kind"), source).alias("line"), "n", "word")


def write_csv(words: DataFrame, path: str) -> None:
    """The whole export of a table of any size, most frequent words first, as text files without the head."""
    csv_lines(words).orderBy(F.desc("n"), "word").select("line").write.mode("overwrite").text(path)


def csv_text(words: DataFrame, most: int = MOST_WORDS) -> str:
    """The export of the `most` most frequent words as one text, with a byte-order mark; `write_csv` has no such bound."""
    rows = csv_lines(words).orderBy(F.desc("n"), "word").limit(most).collect()
    return "﻿word,count,kind,source\n" + "".join(r["line"] + "\n" for r in rows)


def tsv_lines(words: DataFrame) -> DataFrame:
    return words.select(F.concat_ws("\t", F.regexp_replace("word", r"[\t\n]", " "), F.col("n").cast("string")).alias("line"))


def words_json(words: DataFrame, card: str, mode: str, most: int = MOST_WORDS) -> str:
    """The `most` most frequent words as one JSON text."""
    rows = words.orderBy(F.desc("n"), "word").limit(most).collect()
    return json.dumps({"card": card, "mode": mode, "count": len(rows), "words": [{"text": r["word"], "count": r["n"]} for r in rows]}, ensure_ascii=False)


def export_name(template: str, card: str, mode: str, n: int, day: date) -> str:
    """A file name from a template with {card}, {mode}, {date} and {n}; what file systems forbid is taken out."""
    safe = lambda s, most: re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\x00-\x1f]', "", s)).strip(" .")[:most]
    filled = template.format(card=safe(card, 40), mode=safe(mode, 40), date=day.isoformat(), n=n)
    return safe(filled, 120) or "export"


def encode_share(head: dict, words: list[tuple[str, int]]) -> str:
    lines = [json.dumps(head, separators=(",", ":"))] + [f"{w} {n}" for w, n in words]
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return base64.urlsafe_b64encode(packer.compress("\n".join(lines).encode()) + packer.flush()).decode().rstrip("=")


def decode_share(code: str) -> tuple[dict, list[tuple[str, int]]]:
    unpacker = zlib.decompressobj(-15)
    text = unpacker.decompress(base64.urlsafe_b64decode(code + "=" * (-len(code) % 4)), MOST_INFLATED)
    if unpacker.unconsumed_tail:
        raise ValueError("a shared table is too large")
    head, *lines = text.decode().split("\n")
    words = [(w, int(n)) for w, _, n in (line.rpartition(" ") for line in lines[:MOST_WORDS]) if w and n.isdigit()]
    return json.loads(head), words


def share_url(base: str, head: dict, words: list[tuple[str, int]]) -> str:
    """The link with the most words of the ladder that still fits; the bare link where none does."""
    for most in LADDER:
        url = f"{base}#s={encode_share(head, words[:most])}"
        if len(url) <= LONGEST_URL:
            return url
    return base
