"""A word table to show before there is any export: invented words with falling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The words of the demonstration, by language.
WORDS = {
    "en": "lantern harbour orchard compass velvet thunder meadow whisper copper falcon ember quill".split(),
    "de": "laterne hafen garten kompass samt donner wiese falke glut feder kupfer brunnen".split(),
    "zh": "灯笼 港口 果园 罗盘 雷声 草地 低语 铜器 猎鹰 余烬 羽毛 井水".split(),
}


def demo(spark: SparkSession, language: str = "en") -> DataFrame:
    """word, n; an unknown language gets English words."""
    words = WORDS.get(language, WORDS["en"])
    return spark.createDataFrame([(w, 10 * (len(words) - k) ** 2) for k, w in enumerate(words)], "word string, n long")
