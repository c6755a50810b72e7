import pytest

EDGES = [
    (0, None, "en", "a"),
    (1, "", "en", None),
    (2, "   \n\t ", None, "a"),
    (3, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"),
    (4, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"),
    (5, "ÉCOLE naïve — 日本語 \U0001f600 x", "fr", ""),
    (6, "word " * 30_000, "en", "a"),
    (None, "a row without an id", "en", "b"),
    (7, "short", "de", "b"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, COLUMNS)
    return df.withColumns({"n_chars": F.length("text").cast("long"), "node": F.lit(1), "size": F.lit("x"), "kept": F.lit(True), "_key": F.lit(0), "n_words": F.lit(-1)})


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
