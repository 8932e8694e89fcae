"""Small tables with the odd cases that every operator takes: nulls, empty and long texts, ties, repeats, clashing names."""

import pytest

LONG = "word " * 60_000 + "x" * 20_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 3.0, 1),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 3.0, 1),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", None, None, None),
    (None, None, None, None, None),
    (None, "mail joe@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111", "b", 1.0, 2),
    (5, "", "b", 2.0, 0),
    (6, " \t\n ", "b", 2.0, 0),
    (7, LONG, "a", 2.0, 9),
    (8, "naïve ça 漢字 😀 é \x00 \x1c odd breaks\r\n\r\nhere", "c", 0.0, 4),
]
SCHEMA = "doc_id long, text string, source string, length double, n int"
#: Names that operators use themselves.
CLASHES = ["fp", "hash", "slots", "offset", "sequence_id", "kept", "rate", "host", "path", "template", "verdict", "rule", "n_words", "failed", "base_failed", "component_id", "ids", "start", "words", "digest", "name", "original", "row", "share"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
