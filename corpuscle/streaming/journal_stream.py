"""The journal's folds as a stream: counts by window, and runs as they grow.

The batch operators are the reference for results; a stream over the same events, once they
are all processed, gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window of event time and type; events later than the watermark are left out."""
    return events.withWatermark("time", late).groupBy(F.window("time", window), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def running_summary(events: DataFrame) -> DataFrame:
    """Counts a run, kept up to date (output mode ``update`` or ``complete``)."""
    count = lambda name: F.sum((F.col("event") == name).cast("long")).alias(name)
    return events.groupBy("run_id").agg(F.count("*").alias("events"), count("run_start"), count("run_end"), F.max("time").alias("last_time"))
