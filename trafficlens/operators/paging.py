"""Newest-first pages, by offset or by cursor, and page metadata."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import settings as S
from ..functions.times import bucket, ts_lit
from ..session import keep
from .filters import job_rows, maybe_eq, usage_rows

SHALLOW = 10_000


def _check(limit: int, offset: int) -> None:
    if not 0 <= limit <= S.PAGE_MAX:
        raise ValueError(f"limit must be at most {S.PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def newest_page(
    df: DataFrame, limit: int = S.PAGE_DEFAULT, offset: int = 0, ts: str = "created_at", id_: str = "id",
    shallow: int = SHALLOW,
) -> DataFrame:
    """Rows ``offset .. offset+limit`` by (ts, id) descending.

    A shallow page is a top-k. A deep one would move ``offset`` rows to one task, so it first
    finds, from row counts per second, the few seconds the page can lie in, and reads and ranks only
    those.
    """
    _check(limit, offset)
    order = [F.desc(ts), F.desc(id_)]
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    second = bucket(F.col(ts), "second")
    day = bucket(F.col(ts), "day")
    # counts per second, summed up in two levels so that no window holds more than a day of seconds
    per_second = df.groupBy(day.alias("_d"), second.alias("_s")).agg(F.count("*").alias("_n"))
    per_day = per_second.groupBy("_d").agg(F.sum("_n").alias("_nd"))
    newer_days = F.sum("_nd").over(Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1))
    per_day = per_day.select("_d", "_nd", F.coalesce(newer_days, F.lit(0)).alias("_before_day"))
    per_day = per_day.filter((F.col("_before_day") < offset + limit) & (F.col("_before_day") + F.col("_nd") > offset))
    in_day = F.sum("_n").over(
        Window.partitionBy("_d").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        per_second.join(per_day, "_d")
        .withColumn("_before", F.col("_before_day") + F.coalesce(in_day, F.lit(0)))
        .filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset))
        .select("_s", "_before")
    )
    starts = keep(starts, "page_seconds")
    first, last = starts.agg(F.min("_s"), F.max("_s")).first()
    if first is None:
        return df.limit(0)
    # the seconds found are a range that the scan can skip by
    df = df.filter((F.col(ts) >= ts_lit(first)) & (F.col(ts) < ts_lit(last + timedelta(seconds=1))))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy(*order))
    return (
        df.withColumn("_s", second)
        .join(starts, "_s")
        .withColumn("_rank", rank)
        .filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
        .orderBy(*order)
        .drop("_s", "_before", "_rank")
    )


def after_cursor(ts: str, id_: str, cursor: tuple) -> Column:
    """Strictly older than the cursor row in (ts, id) descending order."""
    at, last_id = ts_lit(cursor[0]), F.lit(cursor[1])
    return (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(id_) < last_id))


def newest_page_after(
    df: DataFrame, cursor: tuple | None = None, limit: int = S.PAGE_DEFAULT, ts: str = "created_at", id_: str = "id"
) -> DataFrame:
    """The page after a seek cursor ``(ts, id)``: every page costs the same, however deep."""
    _check(limit, 0)
    if cursor is not None:
        # the first term alone reaches the scan as a pushed filter
        df = df.filter((F.col(ts) <= ts_lit(cursor[0])) & after_cursor(ts, id_, cursor))
    return df.orderBy(F.desc(ts), F.desc(id_)).limit(limit)


def usage_page(usage: DataFrame, limit: int = S.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of usage rows, shaped for output."""
    return usage_rows(newest_page(usage, limit, offset))


def usage_page_after(usage: DataFrame, cursor: tuple | None = None, limit: int = S.PAGE_DEFAULT) -> DataFrame:
    return usage_rows(newest_page_after(usage, cursor, limit))


def jobs_page(jobs: DataFrame, status: str | None = None, limit: int = S.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of jobs, optionally of one state."""
    return job_rows(newest_page(maybe_eq(jobs, "status", status), limit, offset))


def page_info(totals: DataFrame, limit: int = S.PAGE_DEFAULT, page: int = 0) -> DataFrame:
    """Total, page number and whether there is a page before and after (pages count from 0)."""
    return totals.select(
        "total",
        F.lit(page + 1).alias("page_no"),
        F.lit(page > 0).alias("has_prev"),
        (F.lit((page + 1) * limit) < F.col("total")).alias("has_next"),
    )
