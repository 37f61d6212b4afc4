"""Replays against a plain sequential loop."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trafficlens.operators import chains, exact_cache, ratelimit, timeline

T0 = datetime(2024, 1, 1)
ROWS = "id bigint, key string, ts timestamp_ntz, fillable boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, T0 + timedelta(milliseconds=m), f) for i, k, m, f in rows], ROWS)


def random_rows(seed, keys=12, n=1500, span=400_000, hot=True):
    """Several keys; one of them holds a third of all rows, with many equal times."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if hot and r.random() < 0.34 else f"k{r.randrange(keys)}"
        at = r.randrange(span)
        if r.random() < 0.3:
            at = at // 5000 * 5000
        if r.random() < 0.1:
            at += 10 * span
        out.append((i, key, at, r.random() > 0.2))
    return out


def limiter(rows, limits, short, long):
    """Sequential admission per key."""
    slots, out = {}, {}
    for i, key, ms, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        per_short, per_long = limits(key)
        taken = slots.setdefault(key, [])
        in_short = sum(1 for t in taken if t > ms - short)
        in_long = sum(1 for t in taken if t > ms - long)
        if per_short > 0 and in_short >= per_short:
            out[i] = "short"
        elif per_long > 0 and in_long >= per_long:
            out[i] = "long"
        else:
            out[i] = "ok"
            taken.append(ms)
    return out


def decisions(df):
    return {r.id: r.decision for r in df.select("id", "decision").collect()}


@pytest.mark.parametrize("seed,cell,hot", [(1, 60_000, 10**6), (2, 1_000, 0), (3, 7_000, 0), (4, 60_000, 150)])
def test_rate_limit_equals_loop(spark, seed, cell, hot):
    rows = random_rows(seed)
    got = ratelimit.replay_rate_limit(
        frame(spark, rows), key="key", short_seconds=10, long_seconds=100, per_short=3, per_long=12, cell_ms=cell, hot_rows=hot,
        few_stretches=10**6 if seed % 2 else 0,
    )
    assert decisions(got) == limiter(rows, lambda k: (3, 12), 10_000, 100_000)


@pytest.mark.parametrize("seed,per_short,per_long,cell", [(11, 6, 60, 1000), (12, 4, 25, 2500), (13, 5, 0, 10_000), (14, 0, 40, 1000), (15, 3, 200, 20_000)])
def test_rate_limit_cuts_at_calm_windows(spark, seed, per_short, per_long, cell):
    """A hot key with bursts and calm stretches but no silence of the long window."""
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(1500):
        at += r.randrange(200) if i % 150 < 40 else r.randrange(5_000)
        rows.append((i, "hot", at, True))
    got = ratelimit.replay_rate_limit(
        frame(spark, rows), key="key", short_seconds=10, long_seconds=100, per_short=per_short, per_long=per_long, cell_ms=cell, hot_rows=0,
    )
    want = limiter(rows, lambda k: (per_short, per_long), 10_000, 100_000)
    assert decisions(got) == want and len(set(want.values())) > 1


def test_a_key_without_silence_is_replayed_in_many_islands(spark):
    r = random.Random(2)
    points = [("hot", 60_000 * minute + r.randrange(60_000), 1, 0, 3, 10_000) for minute in range(4000) for _ in range(5 if minute % 50 == 7 else 1)]
    df = spark.createDataFrame(points, "key string, ms bigint, n bigint, taken bigint, per_short int, per_long int")
    packed = ratelimit._packed_islands(df, 60_000, 86_400_000, 60_000)
    sizes = [r["count"] for r in packed.groupBy("island").count().collect()]
    # only the bursts with the calm minutes before them are left, each by itself
    assert len(sizes) >= 60 and max(sizes) <= 6


def test_rate_limit_with_overrides(spark):
    rows = random_rows(4)
    table = {"hot": (0, 20), "k1": (2, 0), "k2": (0, 0), "k3": (1, 1)}
    limits = spark.createDataFrame([(k, *v) for k, v in table.items()], "key string, per_short int, per_long int")
    got = ratelimit.replay_rate_limit(
        frame(spark, rows), limits, key="key", short_seconds=10, long_seconds=100, per_short=5, per_long=30
    )
    assert decisions(got) == limiter(rows, lambda k: table.get(k, (5, 30)), 10_000, 100_000)


def test_rate_limit_edges(spark):
    at = [0, 59_999, 60_000, 60_000, 60_001]
    rows = [(i, "k", m, True) for i, m in enumerate(at)]
    one = ratelimit.replay_rate_limit(frame(spark, rows), key="key", per_short=1, per_long=3).orderBy("id").collect()
    # the slot of 0 is gone at exactly 60,000
    assert [r.decision for r in one] == ["ok", "short", "ok", "short", "short"]
    assert one[1].retry_after == 60 and one[1].detail == "rate limit exceeded: 1/minute"
    both = ratelimit.replay_rate_limit(frame(spark, rows), key="key", per_short=1, per_long=1).orderBy("id").collect()
    assert [r.decision for r in both] == ["ok", "short", "long", "long", "long"]
    assert both[2].retry_after == 86400 and both[2].detail == "rate limit exceeded: 1/day"
    off = ratelimit.replay_rate_limit(frame(spark, rows), key="key", per_short=0, per_long=2).orderBy("id").collect()
    assert [r.decision for r in off] == ["ok", "ok", "long", "long", "long"]


@pytest.mark.parametrize("hot", [0, 10**6])
def test_rate_limit_continues_from_slots(spark, hot):
    rows = random_rows(5)
    cut = 200_000
    first, second = [r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]
    args = dict(key="key", short_seconds=10, long_seconds=100, per_short=3, per_long=12, hot_rows=hot)
    a = ratelimit.replay_rate_limit(frame(spark, first), **args)
    done = decisions(a)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    taken = {}
    for i, k, ms, _ in first:
        if done[i] == "ok":
            taken[(k, base + ms)] = taken.get((k, base + ms), 0) + 1
    slots = spark.createDataFrame([(k, m, n) for (k, m), n in taken.items()], "key string, ms bigint, n bigint")
    b = decisions(ratelimit.replay_rate_limit(frame(spark, second), earlier_slots=slots, **args))
    assert {**done, **b} == limiter(rows, lambda k: (3, 12), 10_000, 100_000)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 300), st.integers(1, 4)), min_size=1, max_size=60),
    st.integers(0, 4), st.integers(0, 9), st.integers(1, 30), st.integers(1, 120),
)
def test_replay_cell_equals_loop(points, per_short, per_long, short, long):
    counts = {}
    for ms, n in points:
        counts[ms] = counts.get(ms, 0) + n
    ms = np.array(sorted(counts))
    n = np.array([counts[m] for m in ms])
    a, b = ratelimit._Gate(short), ratelimit._Gate(long)
    accepted, reason = ratelimit._replay_cell(ms, n, a, b, per_short, per_long)
    rows, i = [], 0
    for m, c in zip(ms, n):
        for _ in range(c):
            rows.append((i, "k", int(m), True))
            i += 1
    want = limiter(rows, lambda k: (per_short, per_long), short, long)
    i = 0
    for m, c, acc, why in zip(ms, n, accepted, reason):
        got = ["ok"] * acc + [{1: "short", 2: "long"}.get(int(why))] * (c - acc)
        assert got == [want[j] for j in range(i, i + c)]
        i += c


def cache(rows, ttl):
    """Sequential exact cache per key: (hit, is_fill, fill_id) per request."""
    last, out = {}, {}
    for i, key, ms, fillable in sorted(rows, key=lambda x: (x[2], x[0])):
        if key in last and ms - last[key][0] < ttl:
            out[i] = ("exact", False, last[key][1])
        else:
            out[i] = ("none", fillable, None)
            if fillable:
                last[key] = (ms, i)
    return out


def attributed(df):
    return {r.id: (r.cache_hit, r.is_fill, r.fill_id) for r in df.collect()}


@pytest.mark.parametrize("seed,cell,hot", [(1, 60_000, 10**6), (2, 500, 0), (3, 20_000, 100), (4, 60_000, 100)])
def test_exact_cache_equals_loop(spark, seed, cell, hot):
    rows = random_rows(seed)
    got = exact_cache.replay_exact_cache(
        frame(spark, rows), 20, key="key", fillable="fillable", cell_ms=cell, hot_rows=hot
    )
    assert attributed(got) == cache(rows, 20_000)


@pytest.mark.parametrize("step,cell", [(1, 60_000), (700, 100), (5000, 60_000), (10**6, 1000), (10**9, 60_000)])
def test_jumps_equal_loop(spark, step, cell):
    r = random.Random(step)
    times = {("dense", i) for i in range(3000)} | {("gaps", r.randrange(10**7)) for _ in range(300)} | {("one", 5), ("early", -70_000), ("early", 3)}
    df = spark.createDataFrame(list(times), "key string, ms bigint")
    want = set()
    for key in ("dense", "gaps", "one", "early"):
        due = None
        for ms in sorted(m for k, m in times if k == key):
            if due is None or ms >= due:
                want.add((key, ms))
                due = ms + step
    got = [tuple(x) for x in chains.jumps(df, step, cell).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_hot_key_that_is_never_silent_is_followed_on_many_tasks(spark):
    """A day of a key over 24 cells: the rows of each transfer function lie in several partitions."""
    times = spark.range(0, 86_400, 2).select(F.lit("hot").alias("key"), (F.col("id") * 1000 + F.col("id") % 7).alias("ms"))
    cells = chains.numbered_cells(times, 3_600_000)
    f = chains.transfer(times, cells, 3_600_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for level in (f, chains.doubled(f, 1)):
            sizes = level.groupBy(F.spark_partition_id()).count().toPandas()["count"]
            assert len(sizes) > 3 and sizes.max() < 0.5 * sizes.sum()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert chains.jumps(times, 3_600_000).count() == 24


def test_exact_cache_edges(spark):
    rows = [(0, "k", 0, True), (1, "k", 3_599_999, True), (2, "k", 3_600_000, True), (3, "k", 3_600_000, True)]
    got = attributed(exact_cache.replay_exact_cache(frame(spark, rows), key="key"))
    assert got == {0: ("none", True, None), 1: ("exact", False, 0), 2: ("none", True, None), 3: ("exact", False, 2)}
    twice = [(0, "k", 0, True), (1, "k", 5, True)]
    got = attributed(exact_cache.replay_exact_cache(frame(spark, twice), key="key"))
    assert [g[0] for g in got.values()] == ["none", "exact"] and sum(g[1] for g in got.values()) == 1


@pytest.mark.parametrize("hot", [0, 10**6])
@pytest.mark.parametrize("span", [400_000, 20_000_000])
def test_delayed_cache_equals_loop(spark, hot, span):
    rows = random_rows(9, span=span)
    delay = lambda i: (i * 7919) % 30 * 1000
    df = frame(spark, rows).withColumn("delay", (F.col("id") * 7919) % 30 * 1000)
    got = exact_cache.replay_exact_cache_delayed(df, "delay", 20, key="key", fillable="fillable", hot_rows=hot)
    sets, want = {}, {}
    for i, key, ms, fillable in sorted(rows, key=lambda x: (x[2], x[0])):
        mine = sets.setdefault(key, [])
        hit = any(v < ms < v + 20_000 for v in mine)
        want[i] = ("exact" if hit else "none", fillable and not hit)
        if fillable and not hit:
            mine.append(ms + delay(i))
    assert {r.id: (r.cache_hit, r.is_fill) for r in got.collect()} == want
    assert len(set(want.values())) == (3 if span < 10**6 else len(set(want.values())))


def test_sliding_counts_equal_loop(spark):
    rows = random_rows(6)
    for seconds, cell in ((10, 60_000), (100, 1_000), (60, 60_000)):
        got = timeline.sliding_counts(frame(spark, rows), seconds, key="key", cell_ms=cell)
        w = seconds * 1000
        want = {i: sum(1 for _, k2, m2, _ in rows if k2 == k and m - w < m2 <= m) for i, k, m, _ in rows}
        assert {r.id: r.in_window for r in got.collect()} == want


def test_windows_hold_times_and_not_rows(spark):
    """A hundred requests of one millisecond are one entry, and no column of a row reaches a window."""
    rows = [(i, "k", 5000 if i < 100 else 6000, True) for i in range(101)]
    df = frame(spark, rows)
    got = {r.id: r.in_window for r in timeline.sliding_counts(df, 10, key="key").collect()}
    assert got == {i: 100 if i < 100 else 101 for i in range(101)}
    fills = df.select("key", F.col("ts").alias("fill_ts"))
    for out in (timeline.sliding_counts(df, 10, key="key"), timeline.asof_fill(df, fills, 20, key="key")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and not any("fillable" in line or "struct" in line for line in windows)


def test_islands_equal_loop(spark):
    rows = random_rows(7)
    got = timeline.limiter_islands(frame(spark, rows), 30, key="key")
    want, state = {}, {}
    for i, k, m, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        last, n = state.get(k, (None, 0))
        if last is not None and m - last >= 30_000:
            n += 1
        state[k] = (m, n)
        want[i] = n
    assert {r.id: r.island for r in got.collect()} == want


def test_asof_equals_loop(spark):
    rows = random_rows(8)
    df = frame(spark, rows)
    fills = df.filter("fillable").select("key", F.col("ts").alias("fill_ts"))
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    for cell in (60_000, 3_000):
        got = timeline.asof_fill(df, fills, 20, key="key", cell_ms=cell)
        for r in got.collect():
            at = {i: m for i, _, m, _ in rows}[r.id]
            before = [m for _, k, m, f in rows if f and k == r.key and m <= at]
            want = max(before) if before else None
            assert r.fill_ms == (None if want is None else base + want)
            assert r.alive == (want is not None and at - want < 20_000)
