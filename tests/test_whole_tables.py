"""Queries over whole tables, on tables that go beyond the ids of the small ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstack import plans
from quillstack.operators import ranking

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """sf0.01 with its events dealt to 300 users and parts beyond 10,000."""
    d = str(tmp_path_factory.mktemp("wide"))
    for t in ("documents", "labels", "part", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").withColumns({"events": {"user_id": F.col("event_id") % 300}, "part": {"p_partkey": F.col("p_partkey") * 37}}.get(t, {})).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ["me_annotations_all", "severity_order_all", "recent_revisions_all", "natural_sort_all", "contents_entries_all"])
def test_no_id_is_left_out(spark, wide, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "part", "events"):
        con.execute(f"create view {t} as select * from '{wide}/{t}.parquet/*.parquet'")
    df = plans.queries()[name](spark, wide)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(con.sql(plans.oracle_sql()[name]).select(*df.columns).fetchall(), key=str)
    key = "p_partkey" if "p_partkey" in df.columns else "user_id" if "user_id" in df.columns else "event_id"
    whole = spark.read.parquet(f"{wide}/{'part' if key == 'p_partkey' else 'events'}.parquet")
    if name == "me_annotations_all":
        assert df.agg(F.max("user_id")).first()[0] >= 290
    else:
        assert df.select(key).distinct().count() == whole.select(key).distinct().count()


def test_numbers_of_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    assert [(r.k, r.place) for r in ranking.numbered(df, [F.desc("k")]).orderBy("place").collect()] == [(999 - i, i + 1) for i in range(1000)]
    assert ranking.numbered(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("name", ["outline_order", "severity_order", "natural_sort", "severity_order_all", "natural_sort_all"])
def test_places_come_without_a_global_window(spark, name):
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
