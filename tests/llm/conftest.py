import pytest

DOCS = "doc_id long, text string, source string, n_words int, shard string, score string, kept string, span int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, very long and repeated rows; extra columns with names that operators use as well."""
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "A"), (5, "a"), (None, "null id here"), (None, None),
        (6, long), (7, long + " end"), (8, "same row"), (8, "same row"), (9, "same id"), (9, "other text"),
        (10, "tie one two three"), (11, "tie one two three"), (12, "\U0001f600 é İ Σ"),
    ]
    return spark.createDataFrame(
        [(i, t, None, 1, "x", "y", "z", 0) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (8, None, 0), (8, 1, 1), (12, 1, 0)],
        "doc_id long, quality int, toxic int")
