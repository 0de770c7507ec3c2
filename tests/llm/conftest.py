import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, rank int, score double"
LONG = "word " * 40_000 + "end"
PASSAGE = " ".join(f"passage{k} number{k * 7 % 31}" for k in range(40))
ROWS = [
    (1, "The quick  brown\tfox jumps over the lazy dog", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, "   \n\t ", "de", "b"),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (7, LONG, "en", "a"),
    (8, LONG, "en", "c"),
    (None, "a row without an id", None, None),
    (9, "x", "en", "a"),
    (10, "first " + PASSAGE + " tail of ten", "en", "a"),
    (11, "second start, then " + PASSAGE + " and another tail", "en", "b"),
    (12, "12345 67890 !!", "en", None),
    (13, "日本語のテキスト と <|endoftext|> 🙂", "ja", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, ties, a repeated row, and columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "h", 1, 0.5) for r in ROWS], COLUMNS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
