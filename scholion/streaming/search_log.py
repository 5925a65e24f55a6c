"""The search log as a stream: calls and time by kind in event-time windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cost(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, action_type, calls, seconds); ts may lack a time zone, events later than `late` are left out."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action_type"), F.col("value").alias("cost_time"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "action_type").agg(F.count("*").alias("calls"), F.sum("cost_time").alias("seconds")).select(F.col("window.start").alias("start"), "action_type", "calls", "seconds")
