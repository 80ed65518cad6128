"""Every query runs; those with SQL give the same rows."""

import pytest
from compare import difference, open_duckdb

import __spark_entry__ as contract

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return open_duckdb(sf)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        assert difference(got, duck.sql(ORACLE[name]).df()) is None


def test_entry(spark):
    rows = contract.entry(spark)
    words = contract.queries()["vocab_rank"](spark, contract.ENTRY_DATA).count()
    assert rows.columns == ["query", "word", "similarity", "rank"] and rows.count() == 5 * words
