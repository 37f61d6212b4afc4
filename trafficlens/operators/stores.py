"""Response and vector stores: insert if absent, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..functions.messages import last_user_message
from ..functions.times import expires_at


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key. An aggregate, not a ranking: copies of a key collapse before the shuffle."""
    others = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_first")).select(key, "_first.*").select(*df.columns)


def upsert_responses(
    existing: DataFrame, incoming: DataFrame, key: str = "request_hash", order: list[str] | None = None
) -> DataFrame:
    """Existing rows plus the first incoming row of every key that is not there yet."""
    new = first_per_key(incoming, key, order or ["created_at"])
    absent = new.join(existing.select(key), key, "left_anti")
    return existing.unionByName(absent.select(*[c for c in absent.columns if c in existing.columns]), allowMissingColumns=True)


def attach_response(hits: DataFrame, responses: DataFrame, key: str = "request_hash") -> DataFrame:
    """Hits with the stored response; a hit without one is a miss and drops out."""
    return hits.join(responses.select(key, "response"), key, "inner")


def rows_to_store(
    responses: DataFrame, incoming: DataFrame, ttl_seconds: int = S.CACHE_TTL_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """The rows that a batch of answered requests adds to the two stores.

    ``incoming``: id, request_hash, model, messages, response, embedding, created_at. A response
    is kept once per hash, the first one; the vector store gets an entry for every request that
    has a user text and a vector.
    """
    usage = F.col("response.usage")
    rows = incoming.select(
        "request_hash", "model", "messages", "response",
        usage["prompt_tokens"].alias("prompt_tokens"), usage["completion_tokens"].alias("completion_tokens"),
        "created_at", expires_at(F.col("created_at"), ttl_seconds).alias("expires_at"), "id",
    )
    first = first_per_key(rows, "request_hash", ["created_at", "id"]).drop("id")
    text = last_user_message(F.col("messages"))
    entries = incoming.select("id", "request_hash", "embedding", text.alias("prompt_text"), "model", "created_at")
    entries = entries.filter(F.coalesce(F.col("prompt_text"), F.lit("")) != "").filter(F.col("embedding").isNotNull())
    return first.join(responses.select("request_hash"), "request_hash", "left_anti"), entries


def store_entries(
    responses: DataFrame, entries: DataFrame, incoming: DataFrame, ttl_seconds: int = S.CACHE_TTL_SECONDS
) -> tuple[DataFrame, DataFrame]:
    """Both stores after a batch of answered requests; to append only, write ``rows_to_store``."""
    new_responses, new_entries = rows_to_store(responses, incoming, ttl_seconds)
    kept = new_responses.select(*[c for c in new_responses.columns if c in responses.columns])
    return responses.unionByName(kept, allowMissingColumns=True), entries.unionByName(new_entries)
