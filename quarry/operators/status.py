"""Counts of outcomes by time, for a status page (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hour(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", F.col(ts)), "yyyy-MM-dd HH:mm:ss")
    return events.groupBy(hour.alias("hour"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
