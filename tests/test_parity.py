"""Every registered query against its SQL twin at sf0.01 (feature ids repeat in the smallest tables)."""

import pytest

import __spark_entry__ as entry_module
from cadastre.catalog.parity import duckdb_views, rows_of

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def tables(small):
    return small.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def duck(tables):
    return duckdb_views(tables)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, duck, name):
    df = QUERIES[name](spark, tables)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(columns, cursor.fetchall())


def test_entry(spark, small):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
