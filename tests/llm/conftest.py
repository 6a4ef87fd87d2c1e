import pytest

EDGE_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " row int, key string, body string, fingerprint long, size string, start int, score string, label int"
)


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty and long texts, repeated rows and ids, and texts that differ in white space or case alone."""
    long_text = " ".join(f"w{i % 977} x{i % 1201}, y{i}" for i in range(9000))
    texts = [
        (0, None), (1, ""), (2, " \t\n"), (3, "Alpha beta gamma delta"), (3, "Alpha beta gamma delta"),
        (4, "alpha  beta\ngamma delta"), (5, "Alpha\tbeta gamma  delta"), (6, "É é ß 日本語 😀 token = abcdefgh12"),
        (7, long_text), (8, long_text + " tail"), (9, "one"), (10, "ONE"), (None, "one"), (None, None),
        (11, "12345"), (12, "..."), (13, long_text.upper()),
    ]
    return [(i, t, "en" if i != 9 else None, None, None, 1, "k", "b", 5, "s", 0, "x", 1) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
