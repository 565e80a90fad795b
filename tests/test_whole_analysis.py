"""Queries of the analysis that show every word show more than any round number of them."""

import pytest

from parley.plans import analysis

WORDS, EACH = 100_100, 10_010


@pytest.fixture(scope="module")
def many_words(spark, tmp_path_factory):
    """Ten turns of the one conversation that both queries choose, no word twice."""
    said = [(23, 2 * k + 1, "user", " ".join(f"word{n}" for n in range(k * EACH, (k + 1) * EACH))) for k in range(WORDS // EACH)]
    folder = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_reasoning_words_are_all_shown(spark, many_words):
    assert analysis.reasoning_words(spark, many_words).where("word like 'word%'").count() == WORDS


def test_scoped_words_are_all_shown(spark, many_words):
    assert analysis.analyze_scoped(spark, many_words).where("word like 'word%'").count() == WORDS
