import pytest

#: Rows that every operator must take: nulls, empty and repeated rows, ties, long texts.
EDGES = [
    (None, "words without an id that are long enough to make a line", "en", "a", 1),
    (1, None, "en", None, None),
    (2, "", None, "b", 0),
    (3, " \t\n", "en", "b", 3),
    (4, "one", "en", None, 3),
    (5, "the same words stand here twice in a row and are long enough to count", "en", "a", 60),
    (5, "the same words stand here twice in a row and are long enough to count", "en", "a", 60),
    (6, "x" * 30_000, "en", "a", 30_000),
    (7, "word " * 5_000, "de", "c", 25_000),
    (8, "ÄÖÜ é😀 𝒳   \x00 end", "de", "c", 15),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("ids", "score", "kept", "uid", "label", "set_key", "_size", "_kept", "_row", "_uid", "_key", "spans", "block", "line")
    return edges.select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
