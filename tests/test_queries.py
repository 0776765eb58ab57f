"""Every registered query on document trees against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sylva.plans.queries import oracle_sql, queries

DIR = os.environ.get("SYLVA_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*([repr(x) for x in table[c].to_pylist()] for c in names)))


@pytest.mark.parametrize("name", queries())
def test_query(spark, duck, name):
    assert rows(queries()[name](spark, DIR).toArrow()) == rows(duck.sql(oracle_sql()[name]).to_arrow_table())


def test_entry_without_the_operators_for_training_data():
    """The registry imports without the subpackage llm, and holds these queries either way."""
    import __spark_entry__ as entry

    assert set(queries()) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())
