import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cartwheel.llm.common import importable

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    importable(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture
def edge_documents(llm):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns with names the operators use themselves."""
    long_text = " ".join(f"word{i % 997} und{i % 89}" for i in range(60_000))
    rows = [
        (1, "the cat sat on the mat and then the cat sat on the mat again today", "en", "a", 1),
        (1, "the cat sat on the mat and then the cat sat on the mat again today", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "de", "b", 0),
        (4, "  \t\n ", None, "b", 3),
        (5, "THE CAT sat on the mat and then the cat sat on the mat again today", "en", None, 1),
        (6, long_text, "en", "c", 5),
        (7, "x", "fr", "a", 1),
        (8, "é日本 ▁ <|endoftext|> <s>  \x00 end", "fr", "a", 1),
        (9, "12 345 #*$ %&|", "de", "b", 2),
        (None, "a row without an id but with a few words in it", "en", "c", 2),
    ]
    df = llm.createDataFrame([r + (9, "key", 5, "label") for r in rows],
                             DOC_SCHEMA + ", size int, key string, n int, label string")
    return df
