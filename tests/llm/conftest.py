import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls anywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, text, "a", 1.0, "x"), (2, text, None, None, None), (2, text, None, None, None), (None, text, "b", 2.0, "y"), (None, None, None, None, None),
        (3, None, "c", 3.0, "z"), (4, "", "c", 3.0, "z"), (5, "  \n\t ", "d", 4.0, "q"), (6, "word " * 60_000, "e", 5.0, "w"),
        (7, "one", "f", 6.0, "v"), (8, "Two words", "g", 7.0, "u"), (9, "ünïcödé 中文 😀 <|endoftext|> \x00 x", "h", 8.0, "t"),
    ] + [(100 + i, "hot copy of one text that a third of all rows hold", None, None, None) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, score double, run string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
