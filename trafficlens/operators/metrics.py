"""Counter totals and histograms, computed from the log instead of from one process's registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.errors import classify_error, error_handling
from ..functions.numbers import money

def _label(**parts: Column) -> Column:
    """Labels as one text, ``name=value`` joined by commas in name order."""
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(parts[k].cast("string"), F.lit(""))) for k in sorted(parts)]
    return F.concat_ws(",", *pairs)


def label_groups(usage: DataFrame) -> DataFrame:
    """The log reduced to its finest label set; every counter is a sum over these rows."""
    return usage.groupBy("status", "provider", "cache_hit", "api_key_id").agg(
        F.count("*").alias("n"),
        F.sum("prompt_tokens").alias("pt"),
        F.sum("completion_tokens").alias("ct"),
        F.sum("cost_usd").alias("cost"),
    )


def metric_totals(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """All counters in long form (metric, labels, value) from one scan of the log."""
    return totals_of_groups(label_groups(usage), keys)


def totals_of_groups(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Counters of the reduced log.

    Rejected requests count only as rejections, failed ones not towards tokens and cost. A
    request that reached the semantic cache and missed is a success without hit or an error.
    """
    prefixes = keys.select(F.col("id").alias("api_key_id"), "key_prefix")
    g = groups.join(prefixes, "api_key_id", "left")
    n, status, hit = F.col("n").cast("double"), F.col("status"), F.col("cache_hit")
    ok, asked = status == "success", status.isin("success", "error")

    def item(when: Column, metric: str, labels: Column, value: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(metric).alias("metric"), labels.alias("labels"), value.cast("double").alias("value"))
        )

    provider, prefix, none = F.col("provider"), F.col("key_prefix"), F.lit("")
    items = F.array(
        item(asked, "requests_total", _label(status=status, provider=provider, cache_hit=hit), n),
        item(ok, "tokens_total", _label(provider=provider, kind=F.lit("prompt")), F.col("pt")),
        item(ok, "tokens_total", _label(provider=provider, kind=F.lit("completion")), F.col("ct")),
        item(ok, "cost_usd_total", _label(provider=provider, api_key_prefix=prefix), F.col("cost")),
        item(status == "rate_limited", "rate_limit_rejections_total", _label(api_key_prefix=prefix), n),
        item(asked & (hit == "exact"), "cache_exact_hits_total", none, n),
        item(asked & (hit != "exact"), "cache_exact_misses_total", none, n),
        item(asked & (hit == "semantic"), "cache_semantic_hits_total", none, n),
        item(asked & (hit == "none"), "cache_semantic_misses_total", none, n),
    )
    return (
        g.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("m"))
        .groupBy("m.metric", "m.labels")
        .agg(money(F.sum("m.value")).alias("value"))
    )


def endpoint_of(model: Column) -> Column:
    return F.when(model == "embeddings", "embeddings").otherwise("chat")


def metric_samples(usage: DataFrame, errors: DataFrame, provider: str = "provider", name: str = "error_name") -> DataFrame:
    """(metric, labels as a map, value) of the counters that tell endpoints and failing providers apart.

    ``requests_total`` by endpoint, status, provider and cache layer, the count and sum of
    ``request_duration_seconds`` by endpoint, and ``provider_errors_total`` by provider and class
    from the log of upstream errors. Rejected requests count as requests of their status here.
    """
    endpoint = endpoint_of(F.col("model"))
    done = F.col("status") == "success"
    groups = usage.groupBy(endpoint.alias("endpoint"), "status", F.col(provider).alias("provider"), "cache_hit").agg(
        F.count("*").cast("double").alias("n"),
        F.count_if(done & F.col("latency_ms").isNotNull()).cast("double").alias("timed"),
        F.coalesce(F.sum(F.when(done, F.col("latency_ms"))), F.lit(0)).cast("double").alias("ms"),
    )

    def labels(*names: str) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in names]))

    def item(metric: str, of: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), of.alias("labels"), value.alias("value"))

    items = F.array(
        item("requests_total", labels("cache_hit", "endpoint", "provider", "status"), F.col("n")),
        item("request_duration_seconds_count", labels("endpoint"), F.col("timed")),
        item("request_duration_seconds_sum", labels("endpoint"), F.col("ms") / 1000.0),
    )
    classes = errors_by_provider(errors, provider, name).select(F.col(provider).alias("provider"), "error_class", F.col("errors").cast("double").alias("n"))
    failed = classes.select(F.inline(F.array(item("provider_errors_total", labels("error_class", "provider"), F.col("n")))))
    found = groups.select(F.inline(items)).unionByName(failed)
    # a map is no grouping key: its entries are, in the order of their names
    by = found.groupBy("metric", F.map_entries("labels").alias("_entries")).agg(money(F.sum("value")).alias("value"))
    return by.select("metric", F.map_from_entries("_entries").alias("labels"), "value")


def errors_by_provider(errors: DataFrame, provider: str = "provider", name: str = "error_name") -> DataFrame:
    """Provider errors by class and by what the caller does about them."""
    cls = classify_error(F.col(provider), F.col(name))
    return (
        errors.groupBy(provider, name)
        .agg(F.count("*").alias("n"))
        .withColumn("error_class", cls)
        .groupBy(provider, "error_class")
        .agg(F.sum("n").alias("errors"))
        .withColumn("handling", error_handling(F.col("error_class")))
    )


def latency_histogram(usage: DataFrame, buckets: list[float] | None = None) -> DataFrame:
    """Cumulative duration histogram of the successes: count per upper bound, ``+Inf`` last."""
    bounds = buckets or S.DURATION_BUCKETS
    seconds = F.col("latency_ms") / F.lit(1000.0)
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    counts = [F.count_if(seconds <= F.lit(float(b))) for b in bounds] + [F.count("*")]
    row = usage.filter(F.col("status") == "success").agg(
        F.array(
            *[F.struct(F.lit(n).alias("le"), c.alias("count")) for n, c in zip(names, counts)]
        ).alias("b"),
        F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), 3).alias("sum_seconds"),
    )
    return row.select(F.inline("b"), "sum_seconds")
