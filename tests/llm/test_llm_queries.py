"""Queries with SQL give the same rows; every operator of the list is registered."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import difference, open_duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from lexivec.llm.queries import ORACLE, QUERIES  # noqa: E402


def test_all_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0 and difference(got, open_duckdb(sf).sql(ORACLE[name]).df()) is None
