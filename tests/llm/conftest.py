import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing extra columns."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "  \n\t", "en", "a", 4),
        (4, "Hello THERE world é", "en", "a", 19),
        (5, "hello there world é", "fr", None, 19),
        (5, "hello there world é", "fr", None, 19),
        (6, "HELLO there world É", "fr", "b", 19),
        (None, "no id at all", "en", "b", 12),
        (None, "no id at all", "en", "b", 12),
        (7, "12345 !!! ???", "en", "b", 13),
        (8, "word " * 30000, "en", "c", 150000),
        (9, "one two", "de", "c", 7),
    ]
    extra = "size int, shard string, doc string, value string, label string, `a.b` string"
    full = [r + (1, "x", "y", "z", "w", "q") for r in rows]
    return spark.createDataFrame(full, f"{DOCUMENTS}, {extra}")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
