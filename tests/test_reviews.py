"""Edges of the queries on records that small tables don't show."""

import datetime

from quillstack import plans


def test_ratings_round_halves_to_even(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, 1, "purchase", v) for i, v in enumerate((0.5, 1.5, 2.5, 3.49, 3.5))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "reader")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.event_id: r.rating for r in plans.queries()["reviews"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 3, 2: 3, 3: 4, 4: 5}
