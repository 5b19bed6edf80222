"""The latest state of jobs kept over a stream; an extension, with the batch operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, *, key: str = "job_id") -> DataFrame:
    """Update-mode aggregate: the last record of each job by time, then by number."""
    last = F.max(F.struct("ts", "event_id", "status", "error_code")).alias("l")
    return events.groupBy(key).agg(last).select(key, "l.ts", "l.event_id", "l.status", "l.error_code")
