"""Every query with check SQL against DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.checker import compare
from tests.conftest import SMALL


#: Queries that find nothing in the smallest data; they are held against the next larger one.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    problem = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    if problem and problem.startswith("EMPTY"):
        problem = compare(spark, entry.queries()[name], entry.oracle_sql()[name], LARGER)
    assert problem is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
