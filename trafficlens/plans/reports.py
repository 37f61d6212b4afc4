"""Composite reports: what a user of the service asks for, in few scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.numbers import money, ratio, trunc_int
from ..functions.times import as_datetime, bucket, iso, to_day, window_start
from ..operators import filters, jobs as job_ops, paging, usage as usage_ops

def provider_hourly(usage: DataFrame) -> DataFrame:
    """Per hour and provider: requests, errors, hit rate, p95 of the successes and cost.

    Rows are counted per (hour, provider, status, layer, latency) first, so all figures, the
    percentile included, come from one scan and one combined shuffle.
    """
    ok = F.col("status") == "success"
    counts = usage.groupBy(
        bucket(F.col("created_at"), "hour").alias("hour"), "provider", "status", "cache_hit", "latency_ms"
    ).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost"))
    hits = F.sum(F.when(F.col("cache_hit") != "none", F.col("n")).otherwise(0))
    return counts.groupBy("hour", "provider").agg(
        F.sum("n").alias("requests"),
        F.sum(F.when(F.col("status") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.round(ratio(hits, F.sum("n")), 6).alias("hit_rate"),
        trunc_int(
            F.coalesce(F.percentile(F.when(ok, F.col("latency_ms")), 0.95, F.col("n")), F.lit(0.0))
        ).alias("p95_ms"),
        money(F.sum("cost")).alias("cost_usd"),
    )


def _item(section: str, label: Column, metric: str, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        label.alias("label"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
    )


def overview(usage: DataFrame, as_of: str | datetime, hours: float = 24, minutes_hours: float = 1) -> DataFrame:
    """The overview page in long form (section, label, metric, value), from two scans.

    The first counts per minute and cache layer and feeds totals, breakdown, the minute and the
    hourly series; the second counts the successes per latency and feeds the p95.
    """
    rows = filters.since(usage, as_of, hours=hours)
    recent = F.col("created_at") >= window_start(as_of, hours=minutes_hours)
    cells = rows.groupBy(
        bucket(F.col("created_at"), "minute").alias("minute"), "cache_hit", recent.alias("recent")
    ).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
    )
    hit, n = F.col("cache_hit"), F.col("n")
    hour = iso(bucket(F.col("minute"), "hour"))
    none = F.lit("")
    items = F.array(
        _item("totals", none, "requests", n),
        _item("totals", none, "cost_usd", F.col("cost")),
        _item("totals", none, "tokens", F.col("tokens")),
        _item("totals", none, "hits", F.when(hit != "none", n).otherwise(0)),
        *[_item("breakdown", none, layer, F.when(hit == layer, n).otherwise(0)) for layer in S.CACHE_LAYERS],
        *[_item("cache_hourly", hour, layer, F.when(hit == layer, n).otherwise(0)) for layer in S.CACHE_LAYERS],
        F.when(F.col("recent"), _item("per_minute", iso(F.col("minute")), "count", n)),
    )
    sums = (
        cells.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i"))
        .groupBy("i.section", "i.label", "i.metric")
        .agg(F.round(F.sum("i.value"), 8).alias("value"))
    )
    p95 = usage_ops.p95_latency(usage, as_of, hours).select(
        F.lit("totals").alias("section"), F.lit("").alias("label"), F.lit("p95_latency_ms").alias("metric"),
        F.col("p95_latency_ms").cast("double").alias("value"),
    )
    return sums.unionByName(p95)


def overview_totals_row(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """The headline figures as one row."""
    rows = filters.since(usage, as_of, hours=hours)
    counts = rows.groupBy("status", "cache_hit", "latency_ms").agg(
        F.count("*").alias("n"), F.sum("cost_usd").alias("cost"), F.sum("total_tokens").alias("tokens")
    )
    hits = F.sum(F.when(F.col("cache_hit") != "none", F.col("n")).otherwise(0))
    ok_latency = F.when(F.col("status") == "success", F.col("latency_ms"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"),
        money(F.sum("cost")).alias("cost_usd"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(ratio(hits, F.sum("n")), 6).alias("cache_hit_rate"),
        trunc_int(F.coalesce(F.percentile(ok_latency, 0.95, F.col("n")), F.lit(0.0))).alias("p95_latency_ms"),
    )


def usage_explorer(
    usage: DataFrame,
    from_=None,
    to=None,
    as_of=None,
    api_key_id=None,
    limit: int = S.PAGE_DEFAULT,
    offset: int = 0,
) -> dict[str, DataFrame]:
    """The usage page: ``summary`` (total and daily rows, one scan) and one page of ``rows``."""
    rows = filters.maybe_eq(filters.between_ts(usage, from_, to, as_of), "api_key_id", api_key_id)
    return {
        "summary": usage_ops.usage_rollup(rows),
        "rows": paging.usage_page(rows, limit, offset),
    }


def jobs_report(
    jobs: DataFrame, status: str | None = None, limit: int = S.PAGE_DEFAULT, offset: int = 0
) -> dict[str, DataFrame]:
    """The jobs page: total under the filter, one page of rows, and the lifecycle summary."""
    rows = filters.maybe_eq(jobs, "status", status)
    return {
        "total": usage_ops.filtered_count(rows),
        "rows": paging.jobs_page(rows, None, limit, offset),
        "summary": job_ops.job_summary(rows),
    }
