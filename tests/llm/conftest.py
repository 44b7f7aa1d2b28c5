import pytest
from pyspark.sql import Row

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, fingerprint string, row int, drops int"

ODD = [
    Row(1, None, "en", "a", 0, "x", "y", 1, 2),
    Row(2, "", None, "a", 0, None, None, None, None),
    Row(3, " \n\t\n", "en", None, None, None, None, None, None),
    Row(None, "A null id, but words enough to be a line of its own.", "de", "b", 1, None, None, None, None),
    Row(None, None, None, None, None, None, None, None, None),
    Row(4, "The same text in two rows\nand a second line of it", "en", "a", 5, None, None, None, None),
    Row(4, "The same text in two rows\nand a second line of it", "en", "a", 5, None, None, None, None),
    Row(5, "word " * 30_000 + "\U0001f600 ünïcode ſ K", "en", "a", 5, None, None, None, None),
    Row(6, "x" * 100_000, "en", "a", 5, None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame([tuple(r) for r in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
