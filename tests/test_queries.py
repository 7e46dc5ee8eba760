"""Every registered query against its SQL in DuckDB, and against itself run again."""

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans.registry import ORACLES, QUERIES
from marlstone.sources.readers import TABLES
from tools.compare import rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    mine = rows(QUERIES[name](spark, sf_dir).toArrow())
    theirs = rows(duck.execute(ORACLES[name]).to_arrow_table())
    assert mine[0] == theirs[0]
    assert mine[2] == theirs[2]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns[:2] == ["l_returnflag", "l_linestatus"]
