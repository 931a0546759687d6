import pytest

EDGES = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (None, "one two three four five six seven", "xx", "b", 5),
    (None, None, None, None, None),
    (3, "one two three four five six seven", "en", "b", 5),
    (3, "one two three four five six seven", "en", "b", 5),
    (4, "\n \t\n", "de", "c", 4),
    (5, "word " * 30_000, "en", "c", 150_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows; with columns named like ours."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGES, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(9) for c in ("_row", "kept", "spans", "fingerprint", "_text_hash")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
