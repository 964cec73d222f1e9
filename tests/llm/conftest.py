"""Fixtures of awkward documents."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, row string, good boolean, noise double, group string, key string, quality string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in all columns, empty, blank and very long texts, repeated rows, columns whose names clash with the operators' own."""
    long_text = " ".join(f"word{i % 9973} x{i}" for i in range(60_000))
    prose = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from an old oak tree. " * 1
    texts = [None, "", " \n\t ", "one", "one two three four", prose, prose, prose.upper(), prose + "And so on.", long_text, "élan ñandú ß 漢字 😀 \u0000 end", "a b　c d", "x" * 5000, "same same same " * 40]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, 1, "r", True, 0.5, "g", "k", "q") for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
