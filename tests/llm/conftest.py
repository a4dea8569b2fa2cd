import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", None),
    (4, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "b"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "b"),
    (None, "a row without an id", "en", "b"),
    (6, "wort " * 30_000, "de", "a"),
    (7, "x", "de", None),
    (8, "12 34 !? \U0001f600 中文", None, "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blank and very long texts, ties, repeated rows, and columns named as the operators name theirs."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    names = "score size measures h key s own times id rank part slot words n hub tile node n_chars".split()
    return df.selectExpr("*", *[f"cast(doc_id as long) as {n}" for n in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
