import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000


def odd_rows(spark):
    """Documents with everything that may be odd: nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "Alpha beta gamma delta", "en"), (2, "alpha beta  gamma\tdelta", "en"), (2, "alpha beta  gamma\tdelta", "en"), (None, "no id here at all", None), (None, None, None),
        (3, None, "en"), (4, "", "fr"), (5, " \n\t ", None), (6, LONG, "en"), (7, "été \U0001f600 İstanbul <|endoftext|>", "fr"), (8, "a", "en"), (9, "A", "en"), (6, LONG, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = ["n", "h", "k", "sha", "norm", "bucket", "block", "rank", "length", "fp", "node", "root", "d", "th", "iv", "hits", "kept", "size", "word", "ids", "__row_note"]
    return df.withColumns({c: F.lit(1) for c in extra})


@pytest.fixture(scope="session")
def odd(spark):
    return odd_rows(spark)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
