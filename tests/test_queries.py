"""Every query with a DuckDB twin returns the twin's rows; the others return rows."""

import pytest

import oracle
from conftest import DATA
from sievelake.plans import catalogue


#: Queries that find nothing in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_twin(spark, con, name):
    said = oracle.compare(spark, con, DATA, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert said == "" or (said == "no rows" and name in EMPTY), said


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
