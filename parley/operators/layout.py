"""Where the words of a cloud go: a bounded list, placed on the driver along a spiral, biggest first; and the ranks and sizes of a whole
vocabulary, which is sorted by ranges and numbered by offsets, so no task gets all of it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

CELL = 4


def ranked(rows: DataFrame, *order: Column, collation: str | None = None, name: str = "word") -> DataFrame:
    """rows with `place`, from 0, in an order. Each task numbers its range of it, and adds how many rows the ranges before it have.
    With a collation, as UNICODE or de, ties of `order` stand as its locale sorts the column `name`, and then by code points."""
    last = [F.collate(F.col(name), collation), F.col(name)] if collation else []
    keys = [*order, *last]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(sorted_rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id() % (1 << 33)}))
    before = F.sum("n_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each task
    offsets = placed.groupBy("_part").agg(F.count("*").alias("n_rows")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def display_sizes(words: DataFrame, smallest: float, largest: float, steps: int) -> DataFrame:
    """word, n -> word, size (by the root of its share of the most frequent word's uses), step (of the colour ramp, by rank)."""
    every = words.agg(F.max("n").alias("most"), F.count("*").alias("words"))
    rows = ranked(words, F.desc("n"), F.col("word")).crossJoin(F.broadcast(every))
    size = smallest + (largest - smallest) * F.sqrt(F.col("n") / F.col("most"))
    return rows.select("word", F.round(size, 6).alias("size"), F.least(F.lit(steps - 1), F.floor(F.col("place") * steps / F.col("words"))).cast("int").alias("step"))


def seed_of(text: str) -> int:
    """A 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def place_words(words: list[tuple[str, float]], width: int, height: int, measure: Callable[[str, float], float] | None = None, smallest: float = 14.0, largest: float = 64.0) -> list[dict]:
    """(word, n), most frequent first -> placements that don't overlap: word, x, y (centre), w, h, size. A word for which no
    place is free is left out."""
    measure = measure or (lambda word, size: size * 0.6 * len(word))
    columns, rows = width // CELL, height // CELL
    taken = [0] * rows  # one integer of bits for each row of cells
    out = []
    most = max((n for _, n in words), default=1.0)
    for word, n in words:
        size = smallest + (largest - smallest) * math.sqrt(n / most)
        w, h = measure(word, size), size * 1.1
        cw, ch = math.ceil(w / CELL), math.ceil(h / CELL)
        if cw > columns or ch > rows:
            continue
        turn = seed_of(word) % 360 * math.pi / 180
        mask = (1 << cw) - 1
        for k in range(4000):
            r = 0.35 * k**0.75
            a = turn + 0.3 * math.sqrt(k) * 2
            left, top = round((columns - cw) / 2 + r * math.cos(a) * columns / rows), round((rows - ch) / 2 + r * math.sin(a))
            if left < 0 or top < 0 or left + cw > columns or top + ch > rows:
                continue
            bits = mask << left
            if not any(taken[y] & bits for y in range(top, top + ch)):
                for y in range(top, top + ch):
                    taken[y] |= bits
                out.append({"word": word, "x": left * CELL + w / 2, "y": top * CELL + h / 2, "w": w, "h": h, "size": size})
                break
    return out


#: The distance of characters that stand one below the other, in sizes.
PITCH = 1.05


def can_stack(word: str) -> bool:
    """Whether a word may stand upright in a column: at least two characters, all of them Han, kana or marks of theirs."""
    return len(word) >= 2 and all("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" for c in word)


def stacked(word: str, size: float) -> list[tuple[str, float]]:
    """The characters of a column with the distance of each from the middle."""
    first = -(len(word) - 1) / 2 * PITCH * size
    return [(c, first + k * PITCH * size) for k, c in enumerate(word)]


def layout(words: DataFrame, width: int = 1200, height: int = 800, most: int = 400) -> DataFrame:
    """Placements of the `most` most frequent words (word, n)."""
    top = [(r["word"], float(r["n"])) for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]
    rows = [(p["word"], p["x"], p["y"], p["w"], p["h"], p["size"]) for p in place_words(top, width, height)]
    return words.sparkSession.createDataFrame(rows, "word string, x double, y double, w double, h double, size double")


def svg(placements: DataFrame, width: int = 1200, height: int = 800) -> str:
    """The placements as an SVG text."""
    escaped = F.replace(F.replace(F.replace("word", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.format_string('<text x="%.1f" y="%.1f" font-size="%.1f" text-anchor="middle" dominant-baseline="middle">%s</text>', "x", "y", "size", escaped)
    whole = placements.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t")).first()["t"]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">\n{whole}\n</svg>'
