"""Time columns. Tables hold UTC wall time as TIMESTAMP_NTZ."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F


def as_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def ts_lit(value: str | datetime) -> Column:
    """A TIMESTAMP_NTZ literal; same type as the columns, so comparisons reach the scan."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def window_start(as_of: str | datetime, **span: float) -> Column:
    """``as_of`` minus a span such as ``hours=24`` or ``days=7``."""
    return ts_lit(as_datetime(as_of) - timedelta(**span))


def bucket(ts: Column, unit: str) -> Column:
    """Start of the minute, hour or day of ``ts``."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def iso(ts: Column) -> Column:
    """ISO-8601 text with microseconds, null for null."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def millis(ts: Column) -> Column:
    """Whole milliseconds since the epoch (session time zone must be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def expires_at(ts: Column, ttl_seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))


def is_live(ts_ms: Column, fill_ms: Column, ttl_seconds: int) -> Column:
    """A fill lives while ``ts - fill < ttl``; exactly at the TTL it is gone."""
    return (ts_ms - fill_ms) < F.lit(ttl_seconds * 1000)
