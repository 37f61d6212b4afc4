"""Live versions of the reports: Structured Streaming aggregates kept in tables.

Windows still open change with every micro-batch, so results are written as updates: each batch
appends its own to a table merged in ``levels`` (a repeated batch overwrites its folder, which makes the
sink exactly-once) and the newest row per key is the current result.

Reports that are sums need no stream state at all: each batch is reduced by itself and adds its
row per key to such a table (``write_totals``). Jobs keep state for the open ones only (``write_jobs``).
A watermark drops late rows unseen; ``write_punctual`` decides lateness itself and keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import millis
from ..operators.jobs import job_parts, jobs_of_parts, merge_job_parts
from ..operators.metrics import label_groups, totals_of_groups
from ..session import keep, remove, scratch, scratch_path
from . import levels

EVENT_TIME = "created_at"


def _timed(usage: DataFrame, late: str) -> DataFrame:
    return usage.withColumn("_at", F.col(EVENT_TIME).cast("timestamp")).withWatermark("_at", late)


def _start(width: str):
    return F.window("_at", width)


def _count_where(cond):
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _wall(c: str):
    return F.col(c).cast("timestamp_ntz")


def stream_rpm(usage: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests per minute."""
    counts = _timed(usage, late).groupBy(_start("1 minute")).agg(F.count("*").alias("count"))
    return counts.select(_wall("window.start").alias("minute"), "count")


def stream_hourly(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """Cache mix, errors and rejections per hour."""
    out = _timed(usage, late).groupBy(_start("1 hour")).agg(
        F.count("*").alias("total"),
        *[_count_where(F.col("cache_hit") == h).alias(h) for h in ("none", "exact", "semantic")],
        _count_where(F.col("status") == "error").alias("errors"),
        _count_where(F.col("status") == "rate_limited").alias("rate_limited"),
    )
    return out.select(_wall("window.start").alias("hour"), *[c for c in out.columns if c != "window"])


def stream_latency(usage: DataFrame, late: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Latency quantiles of the successes per hour, from mergeable sketches."""
    ok = _timed(usage, late).filter(F.col("status") == "success")
    q = ok.groupBy(_start("1 hour")).agg(F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("q"))
    return q.select(
        _wall("window.start").alias("hour"),
        *[F.col("q")[i].cast("bigint").alias(n) for i, n in enumerate(("p50", "p95", "p99"))],
    )


def stream_dedupe(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per request id, even if a writer repeats itself within the lateness."""
    rows = _timed(usage, late).dropDuplicatesWithinWatermark(["request_id"])
    return rows.drop("_at")


# running -------------------------------------------------------------------------------------


def _start_batches(stream: DataFrame, path: str, save, trigger: dict, mode: str = "append"):
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_updates(stream: DataFrame, path: str, keys: list[str], **trigger):
    """Start writing the updates of ``stream`` to the table of updates under ``path``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        levels.append(rows, f"{path}/updates", batch_id, levels.newest(keys, "_batch"))

    return _start_batches(stream, path, save, trigger, "update")


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key among all updates."""
    return levels.newest(keys, "_batch")(levels.read(spark, f"{path}/updates")).drop("_batch")


def write_totals(stream: DataFrame, path: str, reduce: Callable[[DataFrame], DataFrame], keys: list[str], **trigger):
    """Start adding ``reduce`` of every batch, sums per ``keys``, to the totals under ``path``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        levels.append(reduce(batch), f"{path}/totals", batch_id, levels.summed(keys))

    return _start_batches(stream, path, save, trigger)


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The sums per key over all batches so far."""
    return levels.summed(keys)(levels.read(spark, f"{path}/totals"))


def write_punctual(
    stream: DataFrame, path: str, reduce: Callable[[DataFrame], DataFrame], keys: list[str],
    width_seconds: int = 60, late_seconds: int = 600, at: str = EVENT_TIME, **trigger,
):
    """Start adding ``reduce`` of the rows on time to the totals under ``path`` and keeping late rows whole.

    As with a watermark, a row is late if its window of ``width_seconds`` ended ``late_seconds`` or more
    before the latest time that earlier batches have seen. A row without a time has no window and counts as late.
    """
    width = width_seconds * 1000

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            rows = keep(batch, "punctual")
            seen = spark.read.parquet(f"{path}/seen/batch_id={batch_id - 1}").head()[0] if batch_id else None
            latest = rows.agg(F.greatest(F.max(millis(F.col(at))), F.lit(seen).cast("bigint")).alias("seen"))
            latest.write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")
            mark = F.lit(None if seen is None else seen - late_seconds * 1000).cast("bigint")
            end = (F.floor(millis(F.col(at)) / F.lit(width)) + 1) * F.lit(width)
            late = F.col(at).isNull() | F.coalesce(end <= mark, F.lit(False))
            out = rows.filter(late).withColumn("watermark", F.timestamp_millis(mark).cast("timestamp_ntz"))
            out.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            levels.append(reduce(rows.filter(~late)), f"{path}/totals", batch_id, levels.summed(keys))
        remove(spark, f"{path}/seen/batch_id={batch_id - 2}")

    return _start_batches(stream, path, save, trigger)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows so far, with the batch they came in and the watermark they missed."""
    return spark.read.parquet(f"{path}/late")


def write_jobs(events: DataFrame, path: str, timeout_seconds: int = 7 * 86_400, **trigger):
    """Start following jobs by their state changes; the state holds one row per open job.

    A job leaves the state when it has succeeded or failed, or when its last change is ``timeout_seconds``
    older than the latest one of its batch. Events that come after that open a row of their own, which the table of
    ended jobs and every reader merge with the earlier ones, so they need not be looked up.
    """
    # a job's row has the same columns in the state and in the table of ended jobs
    schema = job_parts(events.sparkSession.createDataFrame([], events.schema)).schema

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            parts = job_parts(batch)
            if batch_id:
                parts = merge_job_parts(_open_parts(spark, path, schema, batch_id).unionByName(parts))
            parts = keep(parts, "jobs")
            ms = millis(F.col("last.ts"))
            now = parts.agg(F.max(ms)).head()[0]
            quiet = ms <= F.lit(None if now is None else now - timeout_seconds * 1000)
            ended = F.coalesce(F.col("last.status").isin("succeeded", "failed"), F.lit(False)) | F.coalesce(quiet, F.lit(True))
            parts.filter(~ended).write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")
            levels.append(parts.filter(ended), f"{path}/ended", batch_id, merge_job_parts)
        remove(spark, f"{path}/open/batch_id={batch_id - 2}")

    return _start_batches(events, path, save, trigger)


def _open_parts(spark: SparkSession, path: str, schema, n: int) -> DataFrame:
    """The open jobs after ``n`` batches."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/open/batch_id={n - 1}")


def open_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs that the stream still follows."""
    return jobs_of_parts(_open_parts(spark, path, None, levels.batches(spark, f"{path}/ended")))


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Every job's state, wait and run time by the events so far."""
    n = levels.batches(spark, f"{path}/ended")
    ended = levels.read(spark, f"{path}/ended", n=n)
    return jobs_of_parts(merge_job_parts(ended.unionByName(_open_parts(spark, path, ended.schema, n))))


def write_rows(stream: DataFrame, path: str, **trigger):
    """Start appending the rows of ``stream`` to a Parquet table (exactly-once file sink)."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain_updates(stream: DataFrame, keys: list[str], name: str = "updates") -> DataFrame:
    """Process what is available now and return the current result."""
    path = scratch_path(stream.sparkSession, name)
    write_updates(stream, path, keys).awaitTermination()
    return current(stream.sparkSession, path, keys)


def drain_rows(stream: DataFrame, name: str = "rows") -> DataFrame:
    path = scratch_path(stream.sparkSession, name)
    write_rows(stream, path).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


LABELS = ["status", "provider", "cache_hit", "api_key_id"]


def live_counters(usage: DataFrame, keys: DataFrame) -> DataFrame:
    """Counter totals of everything the stream has seen so far."""
    path = scratch_path(usage.sparkSession, "counters")
    write_totals(usage, path, label_groups, LABELS).awaitTermination()
    return totals_of_groups(totals(usage.sparkSession, path, LABELS), keys)


def live_jobs(events: DataFrame) -> DataFrame:
    """Current state of every job by the events the stream has seen so far."""
    path = scratch_path(events.sparkSession, "jobs")
    write_jobs(events, path).awaitTermination()
    return current_jobs(events.sparkSession, path)
