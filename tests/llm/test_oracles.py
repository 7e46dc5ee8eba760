"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from marlstone.llm.oracles import ORACLE_SQL
from marlstone.llm.queries import QUERIES


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert got and plain(got) == plain(want.fetchall())
