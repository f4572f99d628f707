import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and blank texts, ties, repeated rows, a null id, and a very long text."""
    long = " ".join(f"word{i % 977} is number {i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps on a warm mat today"
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "one two three four"),
        (6, base),
        (6, base),
        (7, base),
        (8, base.upper()),
        (9, base + " indeed"),
        (10, long),
        (11, long + " end"),
        (None, base),
        (12, "été à l'école où l'élève apprend le français avec ses amis et son maître"),
        (13, "12345 67890 !!! ???"),
        (14, "日本語の文章とрусский текст"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", "x", 1.0) for k, (i, t) in enumerate(odd_texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, node string, score double"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
