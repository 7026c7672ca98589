"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__
from quillstack import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    r = oracle.execute(plans.oracle_sql()[name])
    names = [c[0] for c in r.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted((tuple(row[i] for i in at) for row in r.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
