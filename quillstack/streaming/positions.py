"""Reading positions kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_positions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, day, last_event, ts: each user's last view of each day; days close when events can be ``late`` no more.

    For a stream with a timestamp column ts, event_id, user_id and event_type; runs on a batch as well.
    """
    views = events.where(F.col("event_type") == "view").withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        views = views.withWatermark("ts", late)
    last = views.groupBy("user_id", F.window("ts", "1 day").alias("day")).agg(F.max(F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", F.col("day.start").alias("day"), F.col("l.event_id").alias("last_event"), F.col("l.ts").alias("ts"))
