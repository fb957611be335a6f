"""Small document tables with every awkward case the operators define a result for."""

from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    """documents from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], DOC)


@pytest.fixture()
def docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture()
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, and columns that clash with the operators' own."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "web", 59),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "web", 59),
        (1, "another text under the same id", None, None, None),
        (None, None, None, None, None),
        (None, "text without an id", "fr", "web", 18),
        (2, "", "en", "web", 0),
        (3, None, "en", "web", None),
        (4, " \n\t\n ", "en", "web", 5),
        (5, long, "en", "web", len(long)),
        (6, "naïve café — déjà vu 你好 世界", "fr", "web", 27),
    ]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 as id", "'x' as th", "'y' as kept", "0 as size", "'z' as gram", "'r' as runs", "0 as shard", "'h' as __h")
