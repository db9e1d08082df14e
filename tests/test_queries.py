"""Every registered query with an oracle agrees with DuckDB, in schema and in values."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, database

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    result = entry.queries()[name](spark, sf).toArrow()
    assert compare(result, duck.execute(ORACLES[name]).to_arrow_table()) == []


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_one_row_per_rank(spark):
    rows = entry.entry(spark).select("tenant_id", "rank").collect()
    assert rows and len(set(rows)) == len(rows)
