"""Text shown in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _fixed(c: Column, places: int) -> Column:
    """Fixed decimals, rounded by the exact binary value and without digit grouping."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * places))


def fmt_usd(c: Column, places: int = 4) -> Column:
    return F.concat(F.lit("$"), _fixed(c, places))


def fmt_pct(c: Column) -> Column:
    return F.concat(_fixed(c * 100, 1), F.lit("%"))


def fmt_label(ts: Column, grain: str) -> Column:
    """Axis label: HH for hours, HH:mm for minutes, MM-dd for days."""
    return F.date_format(ts, {"hour": "HH", "minute": "HH:mm", "day": "MM-dd"}[grain])


def dash(c: Column) -> Column:
    """A dash for null."""
    return F.coalesce(c.cast("string"), F.lit("—"))
