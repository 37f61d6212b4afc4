"""Pricing of usage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..functions.numbers import estimate_cost


def with_cost(df: DataFrame, pricing: DataFrame, out: str = "cost_usd") -> DataFrame:
    """Add the cost of the row's tokens; models without a price cost 0.

    The price list joins by its size: literal rows (``pricing_df``) are broadcast, a large table is shuffled.
    """
    cost = estimate_cost(
        F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_per_1k"), F.col("completion_per_1k")
    )
    return (
        df.join(pricing, ["provider", "model"], "left")
        .withColumn(out, F.coalesce(cost, F.lit(0.0)))
        .drop("prompt_per_1k", "completion_per_1k")
    )


def funnel_usage(attributed: DataFrame, calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """The usage rows of an attributed request log: id, api_key_id, model, provider, tokens, cost, status.

    ``attributed``: id, api_key_id, model, layer, fill_id. ``calls``: id, provider, prompt_tokens,
    completion_tokens, ok, what the provider answers to each request. A cached answer carries the
    provider and model of the response it repeats and costs nothing; a rejected request has no
    provider; a failed one costs nothing either.
    """
    source = attributed.select("*", F.coalesce("fill_id", "id").alias("_of")).join(calls.withColumnRenamed("id", "_of"), "_of")
    first = attributed.select(F.col("id").alias("_of"), F.col("model").alias("_model"))
    rows = source.join(first, "_of")
    rejected, upstream = F.col("layer") == "rate_limited", F.col("layer") == "none"
    paid = upstream & F.col("ok")
    shaped = rows.select(
        "id", "api_key_id",
        F.col("_model").alias("model"),
        F.when(rejected, S.REJECTED_PROVIDER).otherwise(F.col("provider")).alias("provider"),
        *[F.when(paid, F.col(c)).otherwise(0).alias(c) for c in ("prompt_tokens", "completion_tokens")],
        F.when(rejected | upstream, "none").otherwise(F.col("layer")).alias("cache_hit"),
        F.when(rejected, "rate_limited").when(upstream & ~F.col("ok"), "error").otherwise("success").alias("status"),
    )
    return with_cost(shaped, pricing)
