"""Rows of documents and fixtures for the tests (imported by name: a second
conftest module would hide the first)."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

CLASHES = ("id", "n", "h", "t", "key", "norm", "w", "cap", "tokens", "domain", "component", "piece", "start",
           "length", "sequence_id", "kept", "score", "lang_pred", "n_words", "copies", "c")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, clashes=True):
    """Rows of documents, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES}) if clashes else df


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    long_text = "the quick brown fox jumps over a lazy dog 12 times. " * 6000
    same = "One and the same text, twice over.\nWith two lines."
    return [(1, None, "en", "src1", None), (2, "", None, "src1", 0), (3, long_text, "en", None, 1),
            (4, same, "en", "src1", 2), (5, same.upper(), "en", "src2", 2), (5, same.upper(), "en", "src2", 2),
            (None, same, None, None, None), (None, None, None, None, None), (6, " \n\t\n ", "de", "src0", 3),
            (7, "1234 5678 !! ##", "de", "src0", 3), (8, "Mail a.b@c.de\x00\x1f", "fr", "src0", 3),
            (9, "日本語のテキスト <|endoftext|> 'll it's", "fr", "src3", 3)]


@pytest.fixture
def awkward(spark, awkward_rows):
    return make(spark, awkward_rows)


@pytest.fixture
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")
