import re

import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and blank texts, one very long text and word, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 5), (2, "", None, "a", None), (3, " \n\t\n", "en", None, 0), (4, long_text, "en", "a", len(long_text)), (5, "x" * 200_000, "en", "a", 1),
        (6, "one two three four five six seven eight nine ten eleven", "en", "a", 1), (6, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (None, "one two three four five six seven eight nine ten eleven", "en", "a", 1), (7, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (8, "a\r\nb▁c  d\u0000e \U0001f600 漢", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
