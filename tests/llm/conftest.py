import pytest

from llm_tables import docs_table, messy_rows


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    return docs_table(spark, messy_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return docs_table(spark, [])
