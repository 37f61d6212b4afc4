"""Outcome of retried requests, read from the log of their attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import settings as S


def total_backoff(waits: Column, delay: float) -> Column:
    """Sum of ``waits`` exponential waits that start at ``delay`` and stay at 8 times it."""
    d = F.lit(float(delay))
    n = waits.cast("double")
    return F.when(n <= 4, d * (F.pow(F.lit(2.0), n) - 1)).otherwise(d * 15 + d * 8 * (n - 4))


def resolve_attempts(attempts: DataFrame, delay: float = S.RETRY_DELAY_SECONDS) -> DataFrame:
    """Per request: final outcome, provider, last error, attempts, fallbacks and waiting time.

    Providers are tried in order. A success or a fatal error ends the request; whatever the log
    holds after that is ignored. Otherwise the error of the last attempt wins. The log is read and
    shuffled once: the end of a request and the aggregates share the partitioning by request.
    """
    ends = (F.col("outcome") == "ok") | F.col("outcome").isin(S.FATAL)
    stop = F.min(F.when(ends, F.col("attempt_no"))).over(Window.partitionBy("request_id"))
    slim = attempts.filter("request_id IS NOT NULL").select("request_id", "attempt_no", "provider_ord", "provider", "outcome")
    counted = slim.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("attempt_no") <= F.col("stop")))
    per_provider = counted.groupBy("request_id", "provider_ord").agg(
        F.count("*").alias("tries"),
        F.max_by(F.struct("provider", "outcome"), "attempt_no").alias("last"),
    )
    last = F.max_by("last", "provider_ord")
    out = per_provider.groupBy("request_id").agg(
        last.alias("last"),
        F.sum("tries").alias("attempts"),
        (F.count("*") - 1).alias("fallbacks"),
        F.round(F.sum(total_backoff(F.col("tries") - 1, delay)), 6).alias("backoff_seconds"),
    )
    ok = F.col("last.outcome") == "ok"
    return out.select(
        "request_id",
        F.when(ok, "ok").otherwise("error").alias("outcome"),
        F.col("last.provider").alias("provider"),
        F.when(~ok, F.col("last.outcome")).alias("last_error"),
        "attempts", "fallbacks", "backoff_seconds",
    )
