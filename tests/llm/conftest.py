import pytest

ODD = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n\x0b "), (5, "one two three four five six"), (5, "one two three four five six"), (None, "a null id"), (None, None), (6, "É ñ 中文 😀 " * 40), (7, "long " * 30_000), (8, "x" * 70_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows, long texts and words, and columns whose names operators might use themselves."""
    rows = [(i, t, "en", None, 0, "x", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, n long, node long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
