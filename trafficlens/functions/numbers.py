"""Null handling, truncation, ratios and money."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nz(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def trunc_int(c: Column) -> Column:
    """Truncation of a non-negative value; rounding first hides last-bit noise of doubles."""
    return F.floor(F.round(c, 6)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0 or null."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def money(c: Column) -> Column:
    """Sums of doubles depend on their order in the last digits: keep 8 decimals."""
    return F.round(F.coalesce(c, F.lit(0.0)), 8)


def estimate_cost(pt: Column, ct: Column, p_rate: Column, c_rate: Column) -> Column:
    """Token counts times the rates per 1000 tokens."""
    thousand = F.lit(1000.0)
    return pt.cast("double") / thousand * p_rate + ct.cast("double") / thousand * c_rate


def charged(cache_hit: Column, tokens: Column) -> Column:
    """Tokens that are paid for: none on any cache hit."""
    return F.when(cache_hit == "none", tokens).otherwise(F.lit(0))


def backoff_seconds(attempt: Column, delay: float) -> Column:
    """Exponential wait after the ``attempt``-th try, between ``delay`` and 8 times it."""
    raw = F.lit(float(delay)) * F.pow(F.lit(2.0), attempt.cast("double") - 1)
    return F.least(F.greatest(raw, F.lit(float(delay))), F.lit(8.0 * delay))


def chunk_no(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("int")
