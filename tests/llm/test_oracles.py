"""The queries of the subpackage that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from docsift.llm.queries import ORACLE
from docsift.sources.tables import TABLES
from scripts.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, rel = E.queries()[name](spark, SF), con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
