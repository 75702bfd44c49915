"""Continuous intake of works: an extra beside the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlake.operators.dedupe import work_key


def new_works(stream: DataFrame, doi: str = "doi", work_id: str = "id", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Works of a stream once per DOI or id; with an event time the state is kept for `delay` only. Works without a key are dropped."""
    keyed = stream.withColumn("work_key", work_key(F.col(doi), F.col(work_id))).filter("work_key is not null")
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["work_key"])
    return keyed.dropDuplicates(["work_key"])


def counts_by_window(stream: DataFrame, event_time: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window, late rows within the delay included."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))
