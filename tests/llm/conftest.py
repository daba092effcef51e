"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, slot string, digest string, `group size` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents of (doc_id, text[, lang[, source]]), with columns that operators use as names of their own."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None, 1, 2, "x", None, 4) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return make_docs([
        (1, "A line of text here\nanother line of text\nshort", "en", "a"), (2, "A line of text here\nsomething else", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (5, "a LINE of text here \n\n", "fr", "b"), (6, long, "en", "c"), (7, long + " tail", "en", "c"), (7, long + " tail", "en", "c"), (None, "A line of text here\nanother line of text\nshort", "de", None),
        (8, " \t\n", "de", "é"), (9, "one two", "de", "Z"), (10, "ONE two", None, "Z"), (-5, "one two", "de", "Z"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([(1, "x")]).where("doc_id = 0")
