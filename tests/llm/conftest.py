import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and very long texts, repeated rows, a null doc_id, clashing extra columns."""
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, 0), (3, " \n\t ", "en", None, 4), (4, LONG, "en", "s", len(LONG)), (5, "one two", "en", "s", 7),
        (5, "one two", "en", "s", 7), (None, "one two", "fr", "s", 7), (7, "123 456 %%%", "en", "s", 11), (8, "été où ça <|endoftext|> 漢字 ​", "fr", "s", 5), (9, "one  two", "en", "s", 8),
    ]
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, name string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
