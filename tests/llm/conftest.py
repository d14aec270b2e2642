import pytest

LONG = "lorem ipsum dolor " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it. Call +1 (974) 555-3436 now.\n", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it. Call +1 (974) 555-3436 now.\n", "en", "src0"),
    (3, None, None, None),
    (4, "", "en", "src1"),
    (5, " \t\n", "en", "src1"),
    (6, "one two", "en", "src2"),
    (7, "One  TWO", "en", "src2"),
    (8, LONG, "en", "src0"),
    (9, "a <|endoftext|> b\\<|im_end|> é日本🎉 \x1c\x85", "xx", "http://host.example/path/a"),
    (9, "a <|endoftext|> b\\<|im_end|> é日本🎉 \x1c\x85", "xx", "http://host.example/path/a"),
    (None, "without an id", "en", ""),
]


@pytest.fixture
def rows():
    return ROWS


@pytest.fixture
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the operators' own names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "'x' AS score", "1 AS n_tokens", "2 AS h", "3 AS s", "4 AS kept", "5 AS component_id")


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
