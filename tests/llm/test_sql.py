"""Operators that SQL can express give the same rows as DuckDB on whole tables."""

import os

import duckdb
import pytest

from textsentry.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(name, spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    mine, theirs = Q.QUERIES[name](spark, SF).toPandas(), db.execute(Q.ORACLE_SQL[name]).fetchdf()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(tuple, mine[cols].values.tolist())) == sorted(map(tuple, theirs[cols].values.tolist()))
