"""Small tables with every awkward case."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs far away from the old mill by the river bank " * 30


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties."""
    rows = [
        (1, "a b c d e f g h", "en", "s1", 15), (2, "", "en", "s1", 0), (3, None, None, None, None),
        (None, "x y z", "en", "s2", 5), (4, LONG, "en", "s2", len(LONG)), (4, LONG, "en", "s2", len(LONG)),
        (5, "A b C d e F g h", "fr", "s3", 15), (None, None, None, None, None), (6, " \t\n", "en", "", 3),
        (7, "ééé ünï ✓ 🙂 " + LONG, "fr", "s1", 10), (8, LONG, "de", "s9", len(LONG)),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(awkward):
    """Extra columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "slot", "rank", "target", "at", "code", "n", "host", "path", "score", "n_removed", "n_lines", "cell")
    return awkward.withColumns({n: F.lit(f"own {n}") for n in names})
