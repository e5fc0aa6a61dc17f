"""Small tables with every awkward row, shared by the operators' tests."""

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, "one two three"),
    (6, LONG),
    (7, LONG + " tail"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (8, "one two three"),
    (8, "one two three"),
    (9, "  spaces \n\n and   tabs\t\there  "),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """documents with nulls, empty and long texts, repeated rows, and columns
    named like those the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, node long, component string, score double")


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)
