"""Reports and lookups that join keys with their usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.credentials import bearer_state, bearer_token, key_prefix
from ..functions.numbers import money
from ..functions.times import ts_lit
from .filters import key_rows, since

def cost_by_key(usage: DataFrame, keys: DataFrame, as_of, days: float = 7, top: int = 10) -> DataFrame:
    """The keys that spent most; keys without rows in the window stay in, at zero.

    Usage is reduced to one row per key before the join, so a busy key costs nothing there.
    """
    spent = since(usage, as_of, days=days).groupBy("api_key_id").agg(
        money(F.sum("cost_usd")).alias("cost_usd"),
        F.sum("total_tokens").alias("tokens"),
        F.count("id").alias("requests"),
    )
    joined = keys.select("id", "name", F.col("key_prefix").alias("prefix")).join(
        spent, F.col("id") == F.col("api_key_id"), "left"
    )
    return (
        joined.select(
            "id", "name", "prefix",
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("requests", F.lit(0)).alias("requests"),
        )
        .orderBy(F.desc("cost_usd"), "id")
        .limit(top)
    )


def last_used(usage: DataFrame) -> DataFrame:
    return usage.groupBy("api_key_id").agg(F.max("created_at").alias("last_used_at"))


def keys_with_last_used(keys: DataFrame, usage: DataFrame) -> DataFrame:
    used = last_used(usage).withColumnRenamed("api_key_id", "id")
    return keys.join(used, "id", "left")


def keys_report(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """All keys, newest first, with the time of their last use."""
    joined = keys_with_last_used(keys, usage).orderBy(F.desc("created_at"), F.desc("id"))
    return key_rows(joined)


def used_keys(keys: DataFrame, usage: DataFrame, as_of, days: float = 7) -> DataFrame:
    seen = since(usage, as_of, days=days).select(F.col("api_key_id").alias("id")).distinct()
    return keys.join(seen, "id", "left_semi")


def idle_keys(keys: DataFrame, usage: DataFrame, as_of, days: float = 7) -> DataFrame:
    seen = since(usage, as_of, days=days).select(F.col("api_key_id").alias("id")).distinct()
    return keys.join(seen, "id", "left_anti")


def orphans(child: DataFrame, parent: DataFrame, on: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference has no parent; null references are legal."""
    ids = parent.select(F.col(parent_key).alias(on))
    return child.filter(F.col(on).isNotNull()).join(ids, on, "left_anti")


def resolve_keys(
    presented: DataFrame, keys: DataFrame, header: str = "authorization", prefix=key_prefix
) -> DataFrame:
    """Resolve authorization headers to key ids: ok, unknown, revoked, or why not readable."""
    token = bearer_token(F.col(header))
    tagged = presented.withColumn("_prefix", prefix(token)).withColumn("_state", bearer_state(F.col(header)))
    known = keys.select(F.col("key_prefix").alias("_prefix"), F.col("id").alias("api_key_id"), "revoked_at")
    state = (
        F.when(F.col("_state") != "token", F.col("_state"))
        .when(F.col("_prefix").isNull(), "invalid_key")
        .when(F.col("api_key_id").isNull(), "unknown")
        .when(F.col("revoked_at").isNotNull(), "revoked")
        .otherwise("ok")
    )
    return tagged.join(known, "_prefix", "left").select(*presented.columns, "api_key_id", state.alias("resolution"))


def key_snapshot(events: DataFrame, as_of=None) -> DataFrame:
    """Current (or as-of) keys from the ledger of creations and revocations.

    Revoking twice keeps the first time. Plain mergeable aggregates: no row is ever updated and a
    key with very many events is reduced before the shuffle.
    """
    if as_of is not None:
        events = events.filter(F.col("ts") <= ts_lit(as_of))
    create, revoke = F.col("action") == "create", F.col("action") == "revoke"
    state = events.groupBy("key_id").agg(
        F.min(F.when(create, F.col("ts"))).alias("created_at"),
        F.min_by("name", F.when(create, F.col("ts"))).alias("name"),
        F.min_by("is_admin", F.when(create, F.col("ts"))).alias("is_admin"),
        F.min(F.when(revoke, F.col("ts"))).alias("revoked_at"),
    )
    return state.filter(F.col("created_at").isNotNull()).select(
        "key_id", "name", "is_admin", "created_at", "revoked_at",
        F.col("revoked_at").isNull().alias("active"),
    )
