"""Predicates and projections over the tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.times import as_datetime, iso, ts_lit, window_start

ACCESS_STATES = ["not_found", "forbidden", "ok"]


def since(df: DataFrame, as_of: str | datetime, *, col: str = "created_at", **span: float) -> DataFrame:
    """Rows of the last ``hours=``/``days=`` before ``as_of`` (both ends included)."""
    return df.filter((F.col(col) >= window_start(as_of, **span)) & (F.col(col) <= ts_lit(as_of)))


def between_ts(
    df: DataFrame,
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    as_of: str | datetime | None = None,
    col: str = "created_at",
) -> DataFrame:
    """Closed range; ``to`` defaults to ``as_of`` and ``from_`` to 7 days before ``to``."""
    if to is None:
        if as_of is None:
            raise ValueError("give to or as_of")
        to = as_of
    if from_ is None:
        from_ = as_datetime(to) - timedelta(days=7)
    return df.filter(F.col(col).between(ts_lit(from_), ts_lit(to)))


def maybe_eq(df: DataFrame, col: str, value=None) -> DataFrame:
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def success_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "success")


def exclude_providers(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(~F.col("provider").isin(*(names or (S.REJECTED_PROVIDER,))))


def active_keys(keys: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """Keys not revoked; with ``as_of``, keys not yet revoked then."""
    live: Column = F.col("revoked_at").isNull()
    if as_of is not None:
        live = live | (F.col("revoked_at") > ts_lit(as_of))
    return keys.filter(live)


def admin_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("is_admin"))


def usage_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "request_id", F.col("api_key_id").cast("string").alias("api_key_id"), "model", "provider",
        "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "latency_ms", "cache_hit",
        "status", "error", iso(F.col("created_at")).alias("created_at"),
    )


def job_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("id"), F.col("api_key_id").cast("string").alias("api_key_id"),
        "kind", "status", "input", "error",
        *[iso(F.col(c)).alias(c) for c in ("created_at", "started_at", "finished_at")],
    )


def key_rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("id"), "name", F.col("key_prefix").alias("prefix"),
        F.col("user_email").alias("email"), F.col("is_admin").alias("admin"), "rate_limit_overrides",
        *[iso(F.col(c)).alias(c) for c in ("created_at", "revoked_at", "last_used_at") if c in df.columns],
    )


def job_detail(df: DataFrame, include_result: bool = True) -> DataFrame:
    """Job rows; without the result its column is never read from the files."""
    result = F.col("result") if include_result else F.lit(None).cast("string")
    return df.select(
        F.col("id").cast("string").alias("id"), "kind", "status", "input", result.alias("result"), "error",
        *[iso(F.col(c)).alias(c) for c in ("created_at", "started_at", "finished_at")],
    )


def job_access(requests: DataFrame, jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Decide each (job_id, api_key_id) request: missing job, someone else's job, or ok."""
    owners = jobs.select(F.col("id").alias("job_id"), F.col("api_key_id").alias("owner"))
    admins = keys.select(F.col("id").alias("api_key_id"), "is_admin")
    joined = requests.join(owners, "job_id", "left").join(admins, "api_key_id", "left")
    decision = (
        F.when(F.col("owner").isNull(), "not_found")
        .when((F.col("owner") == F.col("api_key_id")) | F.coalesce("is_admin", F.lit(False)), "ok")
        .otherwise("forbidden")
    )
    return joined.select(*requests.columns, decision.alias("decision"))
