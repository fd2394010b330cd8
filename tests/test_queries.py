"""Every registered query that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from textsentry import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(f"{x:.12g}" if isinstance(x, float) else str(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, db):
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in Q.ORACLE_SQL:
        assert rows(got) == rows(db.execute(Q.ORACLE_SQL[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
