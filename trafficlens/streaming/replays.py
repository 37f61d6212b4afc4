"""Live replays: the batch operators applied per micro-batch, with their state in a table.

A keyed state operator would put all requests of one hot key of a micro-batch into one task. The
batch replays do not, so each micro-batch runs them, starting from the state that earlier
batches left. The state is a table merged in ``levels``: a batch reads the live entries of its own keys only
and writes its own changes only, expired entries go when folders are merged, and idle keys are not touched in between.
Rows of a batch live in folders named by the batch number: a batch that is run again after a failure
reads the same state and overwrites its own output. The tables of a batch's own work are removed.
Rows are expected in event order from batch to batch, as a log written at arrival is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import settings as S
from ..functions.times import millis
from ..operators.exact_cache import replay_exact_cache
from ..operators.ratelimit import replay_rate_limit
from ..session import keep, scratch
from . import levels


def _save(df: DataFrame, path: str, kind: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{kind}/batch_id={batch_id}")


def _state(batch: DataFrame, path: str, batch_id: int, schema: str, key: str, lifetime_ms: int, merge: levels.Merge) -> DataFrame:
    """What the batches before left for the keys of this one and its time, one row per entry."""
    first = batch.agg(F.min(millis(F.col("ts")))).head()[0]
    state = levels.read(batch.sparkSession, f"{path}/state", schema, batch_id)
    alive = state.filter(F.col("ms") > F.lit(None if first is None else first - lifetime_ms).cast("bigint"))
    return merge(alive.join(batch.select(F.col(key).alias("key")).distinct(), "key", "left_semi"))


def _add_state(changes: DataFrame, batch: DataFrame, path: str, batch_id: int, lifetime_ms: int, merge: levels.Merge) -> None:
    """Add the batch's entries to the state; merged folders lose what is expired by the batch's time."""
    now = batch.agg(F.max(millis(F.col("ts")))).head()[0]
    alive = F.lit(True) if now is None else F.col("ms") > F.lit(now - lifetime_ms)
    levels.append(changes.filter(alive), f"{path}/state", batch_id, lambda rows: merge(rows.filter(alive)))


def _start(stream: DataFrame, path: str, step, trigger: dict):
    def tidy(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            step(batch, batch_id)

    return (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(tidy)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch_id")


def stream_exact_cache(
    stream: DataFrame, path: str, ttl_seconds: int = S.CACHE_TTL_SECONDS, key: str = "request_hash",
    fillable: str | None = None, **trigger,
):
    """Exact-cache attribution of a request stream; the state is the last live fill per hash."""
    ttl_ms = ttl_seconds * 1000

    def last(fills: DataFrame) -> DataFrame:
        return fills.groupBy("key").agg(F.max(F.struct("ms", "id")).alias("f")).select("key", "f.ms", "f.id")

    schema = f"key {stream.schema[key].dataType.simpleString()}, ms bigint, id bigint"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = keep(batch, "batch")
        fills = keep(_state(rows, path, batch_id, schema, key, ttl_ms, last), "fills")
        out = keep(replay_exact_cache(rows, ttl_seconds, key=key, fillable=fillable, earlier_fills=fills))
        _save(out, path, "rows", batch_id)
        new = out.filter("is_fill").select(F.col(key).alias("key"), millis(F.col("ts")).alias("ms"), "id")
        _add_state(last(new), out, path, batch_id, ttl_ms, last)

    return _start(stream, path, step, trigger)


def stream_rate_limit(
    stream: DataFrame, path: str, limits: DataFrame | None = None, key: str = "api_key_id", trigger: dict | None = None,
    **options,
):
    """Admission of a request stream; the state is the accepted slots of the longest window."""
    schema = f"key {stream.schema[key].dataType.simpleString()}, ms bigint, n bigint"
    together = levels.summed(["key", "ms"])
    widest = 1000 * max(options.get("short_seconds", S.MINUTE_SECONDS), options.get("long_seconds", S.DAY_SECONDS))

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = keep(batch, "batch")
        slots = keep(_state(rows, path, batch_id, schema, key, widest, together), "slots")
        out = keep(replay_rate_limit(rows, limits, key=key, earlier_slots=slots, **options))
        _save(out, path, "rows", batch_id)
        ms = millis(F.col("ts")).alias("ms")
        taken = out.filter(F.col("decision") == "ok").groupBy(F.col(key).alias("key"), ms).agg(F.count("*").alias("n"))
        _add_state(taken, out, path, batch_id, widest, together)

    return _start(stream, path, step, trigger or {})
