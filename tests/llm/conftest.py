"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    long = " ".join(f"word{i % 97} tail{i % 31}" for i in range(20000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon.", "en", "a", 46),
        (2, "The cat sat on the mat and looked at the moon.", "en", "a", 46),
        (2, "The cat sat on the mat and looked at the moon.", "en", "a", 46),
        (3, None, None, None, None),
        (4, "", "de", "", 0),
        (5, " \t\n ", "fr", "b", 4),
        (None, "orphan text without an identifier", "en", "a", 33),
        (None, None, None, None, None),
        (6, long, "en", "b", len(long)),
        (7, "über straße café \U0001f642 漢字 don't we're 123 456", "de", "c", 40),
        (8, "x" * 5000, "es", "c", 5000),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
