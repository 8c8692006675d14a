from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, score string, label string, piece string, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, odd and very long texts, ties and repeated rows, with columns whose names the operators use themselves."""
    texts = [None, "", "  \n ", "one", "two words", "a b c", "the same five words here", "the same five words here", "ÀÉ ﬁ Σς ☃😀 don't I'LL x's", "tab\there\x0bvert\x1cnot\xa0space", "<|endoftext|> in <|startoftext|>text", "l" * 3000 + " " + "word " * 30000, "   three   spaces  end  ", "line\n\n\nline \n x", "0123456789 !!! ??? ---"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "no id"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
