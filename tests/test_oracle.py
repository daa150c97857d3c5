"""Every registered query against its SQL, and the contract around them."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from postmill.queries import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()

needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_data
@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, con, key):
    assert difference(spark, con, QUERIES[key], SQL[key], SF) is None


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
    # Every query of the library has one, with or without the training-data operators.
    assert set(all_queries()) <= set(SQL)


@needs_data
def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@needs_data
def test_audit_sample_is_bounded_and_repeatable(spark):
    sample = QUERIES["skill_audit_sample"]
    risky = "audit_type = 'Potentially Ambiguous Match'"
    first = sorted(sample(spark, SF).filter(risky).collect(), key=str)
    again = sorted(sample(spark, SF).filter(risky).collect(), key=str)
    assert first == again and 0 < len(first) <= 6
    assert all(r.evidence_excerpt for r in first)
