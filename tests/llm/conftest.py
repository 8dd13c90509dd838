import pytest

#: Texts that every operator must bear.
ODD = [None, "", " ", "\n\n", "a", "é", "short text here", "a\x1cb c\xa0d \t e", "x " * 300, "word" * 2000, "日本語 テキスト", "ΑΣ <|endoftext|>", "same row", "same row"]


@pytest.fixture
def odd_docs(spark):
    """Odd texts under ascending ids, the last two with one id, with columns whose names clash with results."""
    rows = [(min(k, len(ODD) - 2), t, None, "s", 7, "x", "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
