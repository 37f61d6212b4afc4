"""Streams over several micro-batches give the batch results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import exact_cache, jobs, metrics, ratelimit, usage
from trafficlens.sources import tables
from trafficlens.sources.driver_views import view
from trafficlens.streaming import levels, live, replays


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    """The usage log and the requests as six files each, in event order."""
    root = tmp_path_factory.mktemp("split")
    out = {}
    for name, ts in (("usage_logs", "created_at"), ("requests_flat", "ts")):
        df = view(spark, sf, name)
        path = str(root / name)
        day = F.dayofmonth(ts)
        for i in range(6):
            part = df.filter((day > i * 5) & (day <= (i + 1) * 5)) if i < 5 else df.filter(day > 25)
            part.coalesce(1).write.mode("append").parquet(path)
        out[name] = path
    return out


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rpm_and_hourly(spark, split):
    u = spark.read.parquet(split["usage_logs"])
    got = live.drain_updates(live.stream_rpm(stream(spark, split["usage_logs"])), ["minute"])
    want = u.groupBy(F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("count"))
    assert rows(got) == rows(want)
    hourly = live.drain_updates(live.stream_hourly(stream(spark, split["usage_logs"])), ["hour"])
    want = usage.cache_hourly(u, "2024-02-01", hours=24 * 40)
    assert rows(hourly.select("hour", "none", "exact", "semantic")) == rows(want)


def test_latency_sketch_is_close(spark, split):
    u = spark.read.parquet(split["usage_logs"])
    got = {r.hour: r for r in live.drain_updates(live.stream_latency(stream(spark, split["usage_logs"])), ["hour"]).collect()}
    want = usage.latency_hourly_approx(u, "2024-02-01", hours=24 * 40).collect()
    assert len(got) == len(want) and all(got[r.t].p50 == r.p50 for r in want)


def test_counters(spark, sf, split):
    keys = view(spark, sf, "api_keys")
    got = live.live_counters(stream(spark, split["usage_logs"]), keys)
    assert rows(got) == rows(metrics.metric_totals(spark.read.parquet(split["usage_logs"]), keys))


def test_dedupe(spark, split):
    s = stream(spark, split["usage_logs"])
    got = live.drain_rows(live.stream_dedupe(s.unionByName(stream(spark, split["usage_logs"])), "40 days"))
    u = spark.read.parquet(split["usage_logs"])
    assert rows(got.select("id", "request_id")) == rows(u.select("id", "request_id"))


def test_jobs(spark, sf, tmp_path):
    events = view(spark, sf, "job_events")
    path = str(tmp_path / "events")
    for status in ("pending", "running", "succeeded", "failed"):
        events.filter(F.col("status") == status).coalesce(1).write.mode("append").parquet(path)
    got = live.live_jobs(stream(spark, path))
    assert rows(got) == rows(jobs.job_lifecycle(events))


def test_exact_cache(spark, split, tmp_path):
    s = stream(spark, split["requests_flat"]).select("id", "ts", "k", "fillable")
    path = str(tmp_path / "cache")
    replays.stream_exact_cache(s, path, 86400, key="k", fillable="fillable").awaitTermination()
    got = replays.rows_of(spark, path)
    batch = spark.read.parquet(split["requests_flat"]).select("id", "ts", "k", "fillable")
    want = exact_cache.replay_exact_cache(batch, 86400, key="k", fillable="fillable")
    assert rows(got) == rows(want)
    assert spark.read.parquet(path + "/rows").select("batch_id").distinct().count() == 6


def test_rate_limit(spark, split, tmp_path):
    s = stream(spark, split["requests_flat"]).select("id", "ts", "event_type")
    path = str(tmp_path / "limit")
    options = dict(key="event_type", short_seconds=7200, per_short=2, per_long=6)
    replays.stream_rate_limit(s, path, **options).awaitTermination()
    batch = spark.read.parquet(split["requests_flat"]).select("id", "ts", "event_type")
    want = ratelimit.replay_rate_limit(batch, **options)
    assert rows(replays.rows_of(spark, path)) == rows(want)
    assert want.select("decision").distinct().count() == 3


def test_usage_table_streams(spark, split, tmp_path):
    path = str(tmp_path / "usage")
    tables.append_usage(spark.read.parquet(split["usage_logs"]), path)
    got = live.drain_updates(live.stream_rpm(tables.stream_usage(spark, path)), ["minute"])
    assert got.agg(F.sum("count")).head()[0] == spark.read.parquet(split["usage_logs"]).count()


def test_scratch_and_state_do_not_grow(spark, split, tmp_path):
    """Six micro-batches leave the rows and two states, and nothing in the shared folder."""
    import os

    from trafficlens.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    requests = spark.readStream.schema(spark.read.parquet(split["requests_flat"]).schema).option("maxFilesPerTrigger", 1)
    frame = requests.parquet(split["requests_flat"]).withColumn("request_hash", F.col("conv_id").cast("string"))
    replays.stream_exact_cache(frame, str(tmp_path / "cache"), 86_400).awaitTermination()
    assert set(os.listdir(folder)) == before
    assert len(list((tmp_path / "cache" / "rows").glob("batch_id=*"))) >= 6
    assert len(list((tmp_path / "cache" / "state").glob("batch_id=*"))) <= 2
    # 4 batches are one merged folder, the last two are one folder each; no other folder is left
    held = {(0, 4), (0, 5), (1, 0)}
    assert set(levels.folders(6)) == held and folders_at(tmp_path / "cache" / "state") == held


def folders_at(path):
    """(level, first batch) of the folders on disk."""
    found = (str(p.relative_to(path)).replace("/", "=").split("=") for p in path.glob("level=*/first=*"))
    return {(int(level), int(first)) for _, level, _, first in found}


def batch_stream(spark, path, batches, schema):
    """A stream that takes each list of rows as a micro-batch."""
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_fifty_batches_are_read_from_few_folders(spark, tmp_path):
    path, merge = str(tmp_path / "t"), levels.summed(["k"])
    for b in range(50):
        # a key of this batch and one that every batch has
        levels.append(spark.createDataFrame([(b, 1), (-1, b)], "k long, v long").coalesce(1), path, b, merge)
        held = levels.folders(b + 1)
        assert len(held) <= (levels.FAN - 1) * 3 and levels.batches(spark, path) == b + 1
        # the folders merged by this batch stay for one more batch, others are gone
        assert set(held) <= folders_at(tmp_path / "t") <= {*held, *levels.folders(b), (0, b)}
    got = {r.k: r.v for r in merge(levels.read(spark, path)).collect()}
    assert got == {-1: sum(range(50)), **dict.fromkeys(range(50), 1)}
    # the merged folder of 16 batches has each key once
    assert spark.read.parquet(f"{path}/level=2/first=0").count() == 17


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path, merge = str(tmp_path / "t"), levels.summed(["k"])
    for b in (0, 1, 2, 3, 3, 4, 4, 5, 6, 7, 7, 7, 8):
        levels.append(spark.createDataFrame([(0, 10**b)], "k long, v long").coalesce(1), path, b, merge)
        assert merge(levels.read(spark, path)).collect()[0].v == int("1" * (b + 1))
        # what the batch itself starts from is still there when it is run again
        before = merge(levels.read(spark, path, "k long, v long", b)).collect()
        assert [r.v for r in before] == ([int("1" * b)] if b else [])


def test_folders():
    assert levels.folders(0) == [] and levels.folders(1) == [(0, 0)]
    for n in range(1, 300):
        covered = [i for level, first in levels.folders(n) for i in range(first, first + levels.FAN**level)]
        assert covered == list(range(n))


def test_state_ends_and_late_events_reopen(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [(1, "pending", t(0)), (2, "pending", t(0)), (3, "pending", t(0)), (4, None, None)],
        [(1, "running", t(1)), (2, "running", t(1)), (2, "succeeded", t(2))],
        # job 1 ends, job 3 has been silent for too long, job 2 is run once more after its end
        [(1, "failed", t(30)), (2, "running", t(29)), (5, "pending", t(30))],
        [(3, "running", t(31)), (3, "succeeded", t(32)), (2, "failed", t(33))],
    ]
    schema = "job_id long, status string, ts timestamp_ntz"
    source = str(tmp_path / "events")
    open_after = [{1, 2, 3}, {1, 3}, {2, 5}, {5}]
    for i, batch in enumerate(batches):
        s = batch_stream(spark, source, [batch], schema)
        live.write_jobs(s, str(tmp_path / "jobs"), timeout_seconds=86_400).awaitTermination()
        assert {r.job_id for r in live.open_jobs(spark, str(tmp_path / "jobs")).collect()} == open_after[i]
        so_far = spark.createDataFrame([r for b in batches[: i + 1] for r in b], schema)
        assert rows(live.current_jobs(spark, str(tmp_path / "jobs"))) == rows(jobs.job_lifecycle(so_far))
    assert len(list((tmp_path / "jobs" / "open").glob("batch_id=*"))) == 2


def test_idle_keys_are_not_written_again(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    idle = [(i, f"idle{i}", t(0)) for i in range(500)]
    batches = [idle, [(1000, "a", t(10)), (1001, "idle7", t(11))], [(1002, "b", t(20)), (1003, "a", t(21))], []]
    source = batch_stream(spark, str(tmp_path / "in"), batches, "id long, request_hash string, ts timestamp_ntz")
    path = str(tmp_path / "cache")
    # three batches: the state of the second and third holds their own fills only
    replays.stream_exact_cache(source, path, 3600).awaitTermination()
    state = tmp_path / "cache" / "state"
    assert folders_at(state) >= {(1, 0)}
    assert spark.read.parquet(f"{path}/state/level=0/first=1").count() == 1
    assert {r.key for r in spark.read.parquet(f"{path}/state/level=0/first=2").collect()} == {"b"}
    assert spark.read.parquet(f"{path}/state/level=1/first=0").count() == 502
    hits = {r.id: r.fill_id for r in replays.rows_of(spark, path).collect() if r.cache_hit == "exact"}
    assert hits == {1001: 7, 1003: 1000}


def test_expired_state_goes_when_folders_merge(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[(i, f"k{i % 3}", t(i * 100))] for i in range(8)]
    source = batch_stream(spark, str(tmp_path / "in"), batches, "id long, request_hash string, ts timestamp_ntz")
    path = str(tmp_path / "cache")
    replays.stream_exact_cache(source, path, 250).awaitTermination()
    alive = levels.read(spark, f"{path}/state").collect()
    assert {r.key for r in spark.read.parquet(f"{path}/state/level=1/first=4").collect()} == {"k0", "k1", "k2"}
    whole = spark.createDataFrame([r for b in batches for r in b], "id long, request_hash string, ts timestamp_ntz")
    assert rows(replays.rows_of(spark, path)) == rows(exact_cache.replay_exact_cache(whole, 250))
    assert len(alive) <= 6


def test_late_rows_are_kept(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [
        [(1, t(0)), (2, t(3600)), (3, None)],
        # the watermark is 3600 - 600 s: a window that ends by then is late
        [(4, t(2939)), (5, t(2940)), (6, t(2999.999)), (7, t(3000)), (8, t(100_000))],
        [],
        [(9, t(99_000)), (10, t(99_400))],
    ]
    source = batch_stream(spark, str(tmp_path / "in"), batches, "id long, created_at timestamp_ntz")
    path, minute = str(tmp_path / "out"), F.date_trunc("minute", "created_at").alias("minute")
    live.write_punctual(source, path, lambda df: df.groupBy(minute).agg(F.count("*").alias("n")), ["minute"]).awaitTermination()
    late = {r.id: r.watermark for r in live.late_rows(spark, path).collect()}
    assert late == {3: None, 4: t(3000), 5: t(3000), 6: t(3000), 9: t(99_400)}
    assert live.totals(spark, path, ["minute"]).agg(F.sum("n")).head()[0] == 5
    assert len(list((tmp_path / "out" / "seen").glob("batch_id=*"))) == 2


@pytest.mark.parametrize("rows_", [3, 4000])
def test_streamed_tables_keep_rows_without_time_and_their_partitions(spark, tmp_path, rows_):
    from trafficlens.plans.stream_catalog import PARTS, stream_table

    at = F.when(F.col("id") % 7 != 5, F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000)).cast("timestamp_ntz")
    table = spark.range(0, rows_, 1, 4).withColumn("ts", at).union(spark.range(-3, 0).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    table.write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        files = spark.read.parquet(str(tmp_path / "t.parquet")).rdd.getNumPartitions()
        batches = []

        def batch(df, _):
            kept = df.withColumn("file", F.input_file_name()).collect()
            batches.append(kept)

        stream = stream_table(spark, str(tmp_path), "t")
        stream.writeStream.foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r["id"] for b in batches for r in b) == list(range(-3, rows_))
    assert len(batches) == PARTS and files > 1
    times = [[r["ts"] for r in b if r["ts"]] for b in batches]
    times = [t for t in times if t]
    assert all(max(a) < min(b) for a, b in zip(times, times[1:], strict=False))
    if rows_ > 1000:
        assert all(len({r["file"] for r in b}) == files for b in batches)
