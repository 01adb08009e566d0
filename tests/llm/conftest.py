import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, and columns with names that operators use inside."""
    prose = " ".join(f"word{k % 97} and the of {k % 31}," for k in range(60))
    long = "\n".join(f"line {k} of a long text with some more words and number {k * k}" for k in range(4000))
    rows = [
        (None, None, None), (None, prose, "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "De.", "b"), (5, prose, "b"), (5, prose, "b"),
        (6, prose + " tail", None), (7, long, "c"), (8, "x" + long, "c"), (9, "a" * 5000, "c"), (10, "mail bob.x@example.com or +1 (523) 555-1055 at 10.0.0.1, card 4111 1111 1111 1111", "c"),
        (11, "<|endoftext|> Á Σίσυφος İ ǅ ́x \x1c don't 👩‍👩‍👧", "a"), (12, "a\r\nb\x0bc\x85d e", "a"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS ids", "1 AS fp", "2 AS d", "3 AS t", "4 AS size", "5 AS kept", "6 AS _n", "7 AS n_words", "8 AS decoded", "'de' AS lang", "length(text) AS n_chars")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
