"""Every registered query against its SQL statement, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canonical
from fleetgauge.bindings import all_oracles, all_queries

ORACLES = entry.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in ORACLES}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def test_every_query_has_a_statement():
    assert set(all_queries()) == set(all_oracles())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, small, duck, name):
    ours = QUERIES[name](spark, small)
    theirs = duck.execute(ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert canonical([tuple(r) for r in ours.collect()], ours.columns) == canonical(theirs.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
