import pytest

#: Texts that every text operator must take: null, empty, blank, short, repeated, very long, odd characters.
ODD_TEXTS = [None, "", " \t\n ", "one", "two words", "same text here " * 30, "same text here " * 30, "é😀 \u2028 ß" * 50, "x" * 30_000, "word " * 30_000, "\x00\x01 a\r\nb", "a\n\n\nb"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated and null ids and a clashing extra column for every name in use."""
    rows = [(k, t, f"x{k}") for k, t in enumerate(ODD_TEXTS)] + [(3, "one", "again"), (3, "other text under the same id", "tie"), (None, "no id", None), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, extra string").selectExpr(
        "doc_id", "text", "extra AS n", "extra AS kind", "extra AS bucket", "extra AS row", "extra AS doc", "extra AS fp", "extra AS rep", "extra AS ids", "extra AS spans", "extra AS base", "extra AS path", "extra AS host", "extra AS rule", "extra AS key", "extra AS label"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
