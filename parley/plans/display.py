"""The cloud's layout and the shared link, over the most frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import layout as L
from parley.operators import sharing as S
from parley.plans.similarity import _all_words


def layout_cloud(spark, sf_dir):
    return L.layout(_all_words(spark, sf_dir))


def share_ladder(spark, sf_dir):
    """Words that a link can carry, decoded from the link again."""
    words = [(r["word"], r["n"]) for r in _all_words(spark, sf_dir).orderBy(F.desc("n"), "word").limit(S.LADDER[0]).collect()]  # no link carries more
    _, back = S.decode_share(S.share_url("https://example.org/", {"theme": "day"}, words).partition("#s=")[2])
    return spark.createDataFrame(back, "word string, n long")


QUERIES = {"layout_cloud": layout_cloud, "share_ladder": share_ladder}
ORACLES: dict[str, str] = {}
