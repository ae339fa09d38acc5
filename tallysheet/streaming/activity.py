"""Daily activity as a stream (ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_daily_activity(marks: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts per event and day. `marks`: event_id, time, created, approved, rejected.

    Rows later than `delay` behind the newest row are dropped with their day's state, so
    state holds only the open days.
    """
    return (
        marks.withWatermark(time, delay)
        .groupBy("event_id", F.window(time, "1 day").alias("day"))
        .agg(
            F.sum("created").alias("created"),
            F.sum(F.col("approved") + F.col("rejected")).alias("reviewed"),
            F.sum("approved").alias("approved"), F.sum("rejected").alias("rejected"),
        )
        .select("event_id", F.to_date("day.start").alias("date"), "created", "reviewed", "approved", "rejected")
    )
