import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(str(DATA / "documents.parquet"))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty texts, ties, repeated rows, and an extra column."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again\nsecond line of the text here", "en", "a", 5, "x"),
        (1, "the quick brown fox jumps over the lazy dog again and again\nsecond line of the text here", "en", "a", 5, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, ""),
        (4, " \t\n \r ", "de", None, 5, "n"),
        (None, "the quick brown fox jumps over the lazy dog again and again\nsecond line of the text here", "en", "b", 5, "key"),
        (5, "The Quick brown fox jumps over the lazy dog again and again\nsecond line of the text here", None, "b", 5, None),
        (6, "one", "fr", "c", 3, "h"),
        (7, "é\U0001f600 中文 x" * 3, "fr", "c", 3, "h"),
        (8, "w " * 60000 + "end. " + "z" * 5000, "en", "c", 3, "h"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
