import pytest
from pyspark.sql import functions as F

LONG = "word soup " * 60_000
TEXTS = [None, "", "   ", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", LONG, "Mail bob@example.com or +1 555 010 9999", "K É ß ퟿ 漢字 10.0.0.1", "x" * 50_000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, repeated and very long texts, null and repeated ids, and extra columns with names that the operators use inside."""
    rows = [(i, t, "en", None if i == 3 else "s", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", "s", 2), (4, TEXTS[4], "en", "s", 1), (4, TEXTS[4], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("id", "key", "fp", "f", "m", "w", "h", "n", "size", "cluster", "source_", "shard", "bin", "label", "node", "tox_score", "pii_base", "pii_found", "item", "words", "pos", "Text_", "y", "anchor", "path")
    return df.withColumns({c: F.lit(f"extra {c}") for c in names})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
