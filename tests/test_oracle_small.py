"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck_connection
from tallyfold.plans import catalog

from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL)


def test_every_query_has_oracle():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["name", "type", "delta", "value"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE[name], con)
    assert res["schema_match"] and res["rows_match"] and res["hash_match"], res
