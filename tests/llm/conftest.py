import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, n_lines string, n_words int, items string, token_ids string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 3, 0.5, "x", "y", 1, "z", "t"),
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 3, 0.5, "x", "y", 1, "z", "t"),
        (2, None, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, None, None, None, None, None, None),
        (4, "   \n\t ", "de", "b", 6, None, None, None, None, None, None),
        (5, "1234 !!! ???", None, None, None, None, None, None, None, None, None),
        (6, long, "en", "c", len(long), None, None, None, None, None, None),
        (7, "é漢😀\x00\x1c x", "fr", "c", 7, None, None, None, None, None, None),
        (None, "no id here at all but enough words to count as a line", "en", "c", 7, None, None, None, None, None, None),
        (8, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "d", 3, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
