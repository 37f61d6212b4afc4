"""Aggregates over the usage log.

Each report takes ``(usage, as_of)`` and a look-back. Percentiles are exact and mergeable: rows
are first counted per distinct latency (combined before the shuffle), so an hour that holds
most of the rows reaches its final task as at most one row per distinct millisecond value.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.numbers import money, ratio, trunc_int
from ..functions.times import bucket, to_day
from .filters import exclude_providers, since, success_only

def _count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def latency_quantiles(df: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``latency_ms`` per group, truncated to whole ms."""
    counts = df.groupBy(*by, "latency_ms").agg(F.count("*").alias("n"))
    points = list(quantiles.values())
    q = counts.groupBy(*by).agg(F.percentile("latency_ms", points, F.col("n")).alias("q"))
    return q.select(
        *by, *[trunc_int(F.coalesce(F.col("q")[i], F.lit(0.0))).alias(name) for i, name in enumerate(quantiles)]
    )


def overview_totals(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    return since(usage, as_of, hours=hours).agg(
        F.count("*").alias("requests"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
    )


def cache_breakdown(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """One row with a count per cache layer, zero where a layer has no rows."""
    return since(usage, as_of, hours=hours).agg(
        *[_count_where(F.col("cache_hit") == layer).alias(layer) for layer in S.CACHE_LAYERS]
    )


def cache_hit_rate(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Hits over ALL rows of the window, rejected and failed ones included."""
    hits = _count_where(F.col("cache_hit").isin("exact", "semantic"))
    return since(usage, as_of, hours=hours).agg(F.round(ratio(hits, F.count("*")), 6).alias("cache_hit_rate"))


def p95_latency(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    return latency_quantiles(success_only(since(usage, as_of, hours=hours)), [], {"p95_latency_ms": 0.95})


def latency_hourly(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    rows = success_only(since(usage, as_of, hours=hours)).select(
        bucket(F.col("created_at"), "hour").alias("t"), "latency_ms"
    )
    return latency_quantiles(rows, ["t"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}).orderBy("t")


def within_rank(rows: DataFrame, approx: DataFrame, by: str, accuracy: int = 10_000) -> DataFrame:
    """Are approximate p50, p95, p99 of ``latency_ms`` within 1/accuracy of their rank, per group?

    A value has the ranks from the share of rows below it to the share at or below it.
    """
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = rows.groupBy(by, "latency_ms").agg(F.count("*").alias("n")).join(approx, by)
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    near = [
        ((share(F.col("latency_ms") < F.col(c)) <= p + 1 / accuracy) & (share(F.col("latency_ms") <= F.col(c)) >= p - 1 / accuracy)).alias(c)
        for c, p in names.items()
    ]
    return counts.groupBy(by).agg(*near)


def latency_hourly_approx(usage: DataFrame, as_of, hours: float = 24, accuracy: int = 10_000) -> DataFrame:
    """The same series from mergeable sketches of bounded size (relative error 1/accuracy)."""
    rows = success_only(since(usage, as_of, hours=hours))
    q = rows.groupBy(bucket(F.col("created_at"), "hour").alias("t")).agg(
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("q")
    )
    return q.select(
        "t", *[F.col("q")[i].cast("bigint").alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    ).orderBy("t")


def errors_hourly(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    errors = _count_where(F.col("status") == "error")
    return (
        since(usage, as_of, hours=hours)
        .groupBy(bucket(F.col("created_at"), "hour").alias("t"))
        .agg(
            errors.alias("errors"),
            _count_where(F.col("status") == "rate_limited").alias("rate_limited"),
            F.count("*").alias("total"),
            F.round(ratio(errors, F.count("*")), 6).alias("error_rate"),
        )
        .orderBy("t")
    )


def requests_per_minute(usage: DataFrame, as_of, hours: float = 1) -> DataFrame:
    return (
        since(usage, as_of, hours=hours)
        .groupBy(bucket(F.col("created_at"), "minute").alias("minute"))
        .agg(F.count("*").alias("count"))
        .orderBy("minute")
    )


def cache_hourly(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    return (
        since(usage, as_of, hours=hours)
        .groupBy(bucket(F.col("created_at"), "hour").alias("hour"))
        .agg(*[_count_where(F.col("cache_hit") == layer).alias(layer) for layer in S.CACHE_LAYERS])
        .orderBy("hour")
    )


def tokens_by_provider(usage: DataFrame, as_of, days: float = 7) -> DataFrame:
    """Tokens per day and provider (long form); rejections have no provider and are left out."""
    return (
        exclude_providers(since(usage, as_of, days=days))
        .groupBy(bucket(F.col("created_at"), "day").alias("d"), "provider")
        .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
        .orderBy("d", "provider")
    )


def provider_list(usage: DataFrame, as_of, days: float = 7) -> DataFrame:
    return exclude_providers(since(usage, as_of, days=days)).select("provider").distinct().orderBy("provider")


def tokens_by_provider_wide(
    usage: DataFrame, as_of, days: float = 7, providers: list[str] | None = None
) -> DataFrame:
    """One column per provider, zero-filled. Without a given list the (few) names are read first."""
    if providers is None:
        limit = int(usage.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        names = provider_list(usage, as_of, days).limit(limit + 1).collect()
        if len(names) > limit:
            raise ValueError("too many providers for columns; use tokens_by_provider")
        providers = [r.provider for r in names]
    long = tokens_by_provider(usage, as_of, days)
    return long.groupBy("d").pivot("provider", providers).agg(F.sum("tokens")).na.fill(0).orderBy("d")


def rate_limit_hourly(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    return (
        since(usage, as_of, hours=hours)
        .filter(F.col("status") == "rate_limited")
        .groupBy(bucket(F.col("created_at"), "hour").alias("t"))
        .agg(F.count("*").alias("rejections"))
        .orderBy("t")
    )


def _usage_sums() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        money(F.sum("cost_usd")).alias("cost_usd"),
    ]


def usage_aggregate(df: DataFrame) -> DataFrame:
    """Totals over rows that are already filtered to a range."""
    return df.agg(*_usage_sums(), trunc_int(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"))


def usage_daily(df: DataFrame) -> DataFrame:
    return df.groupBy(to_day(F.col("created_at")).alias("day")).agg(*_usage_sums()).orderBy("day")


def usage_rollup(df: DataFrame) -> DataFrame:
    """The daily rows and the total (``day`` null, ``is_total``) from a single scan."""
    days = df.withColumn("day", to_day(F.col("created_at")))
    return days.rollup("day").agg(
        *_usage_sums(),
        trunc_int(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"),
        (F.grouping("day") == 1).alias("is_total"),
    )


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def latency_by_layer(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Per cache layer: rows, share of all, and average, median and p95 latency (successes only).

    One counting pass per (layer, latency) feeds every figure.
    """
    rows = success_only(since(usage, as_of, hours=hours))
    counts = rows.groupBy("cache_hit", "latency_ms").agg(F.count("*").alias("n"))
    layers = counts.groupBy("cache_hit").agg(
        F.sum("n").alias("hits"),
        (F.sum(F.col("latency_ms").cast("double") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("latency_ms", [0.5, 0.95], F.col("n")).alias("q"),
    )
    # at most one row per cache layer from here on
    packed = layers.agg(F.sum("hits").alias("all"), F.collect_list(F.struct("*")).alias("rows"))
    return (
        packed.select("all", F.inline("rows"))
        .select(
            "cache_hit",
            "hits",
            F.round(ratio(F.col("hits"), F.col("all")), 6).alias("share"),
            trunc_int(F.col("mean")).alias("avg_ms"),
            trunc_int(F.col("q")[0]).alias("p50_ms"),
            trunc_int(F.col("q")[1]).alias("p95_ms"),
        )
        .orderBy("cache_hit")
    )


def cost_saved(usage: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Cache hits times the average cost of a paid answer, in one pass."""
    ok = F.col("status") == "success"
    hits = _count_where(ok & F.col("cache_hit").isin("exact", "semantic"))
    misses = _count_where(ok & (F.col("cache_hit") == "none"))
    paid = F.sum(F.when(ok & (F.col("cache_hit") == "none"), F.col("cost_usd")))
    return since(usage, as_of, hours=hours).agg(
        hits.alias("hits"),
        misses.alias("misses"),
        money(ratio(paid, misses)).alias("avg_miss_cost"),
        money(hits * ratio(paid, misses)).alias("cost_saved"),
    )


def preset_counts(usage: DataFrame, as_of, days: tuple[int, ...] = (1, 3, 7, 14, 30)) -> DataFrame:
    """Requests of the last 1, 3, 7, ... days, all from one scan of the longest range."""
    from ..functions.times import window_start

    rows = since(usage, as_of, days=max(days))
    return rows.agg(
        *[_count_where(F.col("created_at") >= window_start(as_of, days=d)).alias(f"last_{d}d") for d in days]
    )


def rollup_daily(usage: DataFrame) -> DataFrame:
    """The nightly rollup: one row per day, key, provider, model, status and cache layer."""
    return usage.groupBy(
        to_day(F.col("created_at")).alias("day"), "api_key_id", "provider", "model", "status", "cache_hit"
    ).agg(
        F.count("*").alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("latency_ms").alias("latency_ms_sum"),
    )


def write_rollup(usage: DataFrame, path: str) -> None:
    """Rewrite only the day folders present in ``usage``; running a day again changes nothing."""
    (
        rollup_daily(usage)
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


SKETCH_SIZE = 1000  # items of a quantile sketch: a rank error of about 0.3 %


def latency_sketches(usage: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """The rollup of latencies: one mergeable quantile sketch per day, hour, key and provider.

    Only successful requests with a latency count, as in the other latency reports.
    """
    rows = success_only(usage).filter(F.col("latency_ms").isNotNull())
    hour = bucket(F.col("created_at"), "hour").alias("t")
    return rows.groupBy(to_day(F.col("created_at")).alias("day"), hour, "api_key_id", "provider").agg(
        F.count("*").alias("requests"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), size).alias("latency")
    )


def write_sketches(usage: DataFrame, path: str, size: int = SKETCH_SIZE) -> None:
    """Rewrite only the day folders present in ``usage``."""
    (
        latency_sketches(usage, size)
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def latency_from_rollup(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, requests, p50, p95, p99) for any grouping and range of stored sketches; no raw row is read."""
    merged = sketches.groupBy(*by).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("latency").alias("latency"))
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return merged.select(*by, "requests", *[F.kll_sketch_get_quantile_bigint("latency", F.lit(q)).alias(n) for n, q in shares.items()])


def retain(usage: DataFrame, as_of: str | datetime, days: float = 30, col: str = "created_at") -> DataFrame:
    """Raw rows young enough to keep."""
    from ..functions.times import window_start

    return usage.filter(F.col(col) >= window_start(as_of, days=days))


def traffic_mix(usage: DataFrame) -> DataFrame:
    """Requests by endpoint, status and cache layer with their share of all requests."""
    endpoint = F.when(F.col("model") == "embeddings", "embeddings").otherwise("chat")
    groups = usage.groupBy(endpoint.alias("endpoint"), "status", "cache_hit").agg(F.count("*").alias("requests"))
    # a handful of label combinations: pack them to attach the total
    packed = groups.agg(F.sum("requests").alias("all"), F.collect_list(F.struct("*")).alias("rows"))
    return packed.select("all", F.inline("rows")).select(
        "endpoint", "status", "cache_hit", "requests", F.round(ratio(F.col("requests"), F.col("all")), 6).alias("share")
    )
