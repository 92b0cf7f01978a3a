import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, n_lines int, x string, rejected string, tid int"


def _row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "r", 1, 2, "x", "no", 3)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; columns whose names operators use."""
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        _row(1, None),
        _row(2, ""),
        _row(3, " \t\n "),
        _row(4, "One two three four five\nsame line\nsix seven", None, None),
        _row(4, "One two three four five\nsame line\nsix seven", None, None),
        _row(5, "one TWO three four five\nsame line\nsix seven", "en", "t"),
        _row(None, "a document without an id\nsame line"),
        _row(6, long_text, "fr", "s"),
        _row(7, long_text, "fr", "s"),
        _row(8, "été ça va 中文 \U0001f600   x\x1cy <|endoftext|> Σ", "fr", ""),
        _row(9, "123 456"),
    ]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
