"""Job lifecycle: state machine, waits and run times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions.numbers import trunc_int
from ..functions.times import millis, ts_lit

# order of the states, for events that carry the same time
STATE_RANK = {"pending": 0, "running": 1, "succeeded": 2, "failed": 2}


def _seconds(a: Column, b: Column) -> Column:
    """Whole seconds from ``a`` to ``b``."""
    return F.floor((millis(b) - millis(a)) / F.lit(1000)).cast("bigint")


def job_parts(events: DataFrame) -> DataFrame:
    """One row per job with what its events say of it; rows of several sets of events can be merged."""
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])[F.col("status")]
    done = F.col("status").isin("succeeded", "failed")
    return events.groupBy("job_id").agg(
        F.max(F.struct("ts", rank.alias("rank"), "status")).alias("last"),
        F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(done, F.col("ts"))).alias("finished_at"),
    )


def merge_job_parts(parts: DataFrame) -> DataFrame:
    """One row per job from the rows of several sets of events."""
    return parts.groupBy("job_id").agg(
        F.max("last").alias("last"),
        F.min("created_at").alias("created_at"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
    )


def jobs_of_parts(parts: DataFrame) -> DataFrame:
    """State, queue wait and run time of jobs with one row each."""
    return parts.select(
        "job_id", F.col("last.status").alias("status"), "created_at", "started_at", "finished_at",
        _seconds(F.col("created_at"), F.col("started_at")).alias("queue_seconds"),
        _seconds(F.col("started_at"), F.col("finished_at")).alias("run_seconds"),
    )


def job_lifecycle(events: DataFrame, as_of=None, stuck_after_seconds: int | None = None) -> DataFrame:
    """State, queue wait and run time per job from its state-change events.

    With ``as_of`` only earlier events count, and a job that has been running longer than
    ``stuck_after_seconds`` by then is marked as stuck.
    """
    if as_of is not None:
        events = events.filter(F.col("ts") <= ts_lit(as_of))
    out = jobs_of_parts(job_parts(events))
    if as_of is not None and stuck_after_seconds is not None:
        running = F.col("status") == "running"
        age = _seconds(F.col("started_at"), ts_lit(as_of))
        out = out.withColumn("stuck", running & (age > F.lit(stuck_after_seconds)))
    return out


def job_summary(jobs: DataFrame) -> DataFrame:
    """Per state: number of jobs, average queue wait and run time in whole seconds."""
    wait = _seconds(F.col("created_at"), F.col("started_at"))
    run = _seconds(F.col("started_at"), F.col("finished_at"))
    return jobs.groupBy("status").agg(
        F.count("*").alias("jobs"),
        trunc_int(F.avg(wait)).alias("avg_queue_seconds"),
        trunc_int(F.avg(run)).alias("avg_run_seconds"),
    )


def check_transitions(events: DataFrame) -> DataFrame:
    """Jobs per verdict: valid, or what their events break of the state machine."""
    first = events.groupBy("job_id").agg(
        F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("p"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("r"),
        F.min(F.when(F.col("status").isin("succeeded", "failed"), F.col("ts"))).alias("f"),
        F.count_if(F.col("status") == "succeeded").alias("n_ok"),
        F.count_if(F.col("status") == "failed").alias("n_bad"),
    )
    problem = (
        F.when(F.col("p").isNull(), "never created")
        .when(F.col("f").isNotNull() & F.col("r").isNull(), "finished without running")
        .when(F.col("r") < F.col("p"), "ran before creation")
        .when(F.col("f") < F.col("r"), "finished before running")
        .when((F.col("n_ok") > 0) & (F.col("n_bad") > 0), "both succeeded and failed")
        .otherwise("valid")
    )
    return first.groupBy(problem.alias("verdict")).agg(F.count("*").alias("jobs"))
