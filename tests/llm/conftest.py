import pytest
from edge_cases import ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, with further columns whose names clash with those that operators use inside."""
    rows = [(i, t, "x", 1, None) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, size int, _row long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
