"""Debouncing: of events that follow each other closely only the last counts, once it has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def debounced(events: DataFrame, gap: str, keys: list[str], value: list[str], time_col: str = "ts", order_col: str = "event_id", late: str | None = None) -> DataFrame:
    """(keys, first_at, last_at, n, value): a row for each run of a key's events with less than ``gap`` between neighbours.

    ``value`` are columns of the run's last event; ``order_col`` decides between events of one time.  A session window over event time, so
    runs are merged as they arrive, in a batch or a stream; ``late`` is a stream's watermark.  Events without a time are left out.
    """
    if late is not None:
        events = events.withWatermark(time_col, late)
    last = F.max(F.struct(time_col, order_col, *(c for c in value if c != order_col)))
    zoned = events.schema[time_col].dataType == TimestampType()
    # A time without a zone counts from the epoch's own clock, whatever the session's zone.
    at = lambda c: F.unix_micros(c) if zoned else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    runs = events.groupBy(*keys, F.session_window(time_col, gap).alias("_w")).agg(F.count("*").alias("n"), F.min(time_col).alias("_first"), last.alias("_last"))
    return runs.select(*keys, at(F.col("_first")).alias("first_at"), at(F.col("_last")[time_col]).alias("last_at"), "n", *(F.col("_last")[c].alias(c) for c in value))
