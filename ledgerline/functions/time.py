"""Epoch milliseconds and calendar buckets, always UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def ms_of(ts: Column | str) -> Column:
    """Whole milliseconds since the epoch, floored; NULL stays NULL."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def ts_of(ms: Column) -> Column:
    """Timestamp of epoch milliseconds, where 0 means unknown and becomes NULL."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0).cast("long")))


def day_of(ts: Column | str) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp").cast("date")


def month_of(ts: Column | str) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")


def hour_ms(ms: Column) -> Column:
    return (F.floor(ms / HOUR_MS) * HOUR_MS).cast("long")
