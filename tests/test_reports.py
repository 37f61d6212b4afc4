"""Edge cases of the reports, sources and paging."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import attempts, filters, inputs, keys, paging, quality, stores, usage
from trafficlens.plans import reports
from trafficlens.sources import documents, schemas, tables

NOW = "2024-01-31 00:00:00"
USAGE = "id bigint, api_key_id bigint, provider string, model string, total_tokens int, cost_usd double, latency_ms int, cache_hit string, status string, created_at timestamp_ntz"


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], USAGE)


def row(at, key=1, provider="openai", tokens=10, cost=0.5, latency=100, hit="none", status="success"):
    return (key, provider, "m", tokens, cost, latency, hit, status, datetime.fromisoformat(at))


def test_empty_window(spark):
    u = log(spark, row("2024-01-01 00:00:00"))
    assert usage.overview_totals(u, NOW).collect() == [(0, 0.0, 0)]
    assert usage.cache_breakdown(u, NOW).collect() == [(0, 0, 0)]
    assert usage.cache_hit_rate(u, NOW).head()[0] == 0.0
    assert usage.p95_latency(u, NOW).head()[0] == 0
    for report in (usage.latency_hourly, usage.errors_hourly, usage.requests_per_minute, usage.cache_hourly, usage.rate_limit_hourly):
        assert report(u, NOW).collect() == []
    assert tuple(reports.overview_totals_row(u, NOW).head()) == (0, 0.0, 0, 0.0, 0)


def test_window_ends_are_included(spark):
    u = log(spark, row("2024-01-30 00:00:00"), row("2024-01-29 23:59:59.999999"), row(NOW), row("2024-01-31 00:00:00.000001"))
    assert usage.overview_totals(u, NOW).head().requests == 2


def test_hit_rate_counts_all_rows(spark):
    u = log(spark, row(NOW, hit="exact"), row(NOW, hit="semantic"), row(NOW, status="error"), row(NOW, status="rate_limited", provider="ratelimit"))
    assert usage.cache_hit_rate(u, NOW).head()[0] == 0.5


def test_hour_without_success(spark):
    u = log(spark, row("2024-01-30 10:00:00", status="error"), row("2024-01-30 11:00:00", latency=7))
    assert [tuple(r)[1:] for r in usage.latency_hourly(u, NOW).collect()] == [(7, 7, 7)]
    e = usage.errors_hourly(u, NOW).collect()
    assert [(r.errors, r.total, r.error_rate) for r in e] == [(1, 1, 1.0), (0, 1, 0.0)]


def test_percentiles_interpolate_and_truncate(spark):
    u = log(spark, *[row(NOW, latency=x) for x in (10, 20, 30, 41)])
    assert tuple(usage.latency_hourly(u, NOW).head())[1:] == (25, 39, 40)


def test_approximate_percentiles_are_order_statistics(spark, sf):
    from trafficlens.sources.driver_views import view

    u = view(spark, sf, "usage_logs")
    values = {}
    for r in u.filter("status = 'success'").select(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("t"), "latency_ms").collect():
        values.setdefault(r.t, []).append(r.latency_ms)
    got = usage.latency_hourly_approx(u, NOW, hours=24 * 31).collect()
    assert len(got) == len(values)
    for r in got:
        v = sorted(values[r.t])
        for q, x in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert x == v[math.ceil(q * len(v)) - 1]


def test_unused_keys_stay(spark):
    k = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2"), (3, "c", "p3")], "id bigint, name string, key_prefix string")
    u = log(spark, row("2024-01-30 10:00:00", key=2), row("2024-01-01 00:00:00", key=3))
    got = [(r.id, r.cost_usd, r.tokens, r.requests) for r in keys.cost_by_key(u, k, NOW).collect()]
    assert got == [(2, 0.5, 10, 1), (1, 0.0, 0, 0), (3, 0.0, 0, 0)]


def test_wide_tokens(spark):
    u = log(spark, row("2024-01-30 10:00:00", provider="b"), row("2024-01-29 10:00:00", provider="a", tokens=3), row(NOW, provider="ratelimit"))
    got = usage.tokens_by_provider_wide(u, NOW)
    assert got.columns == ["d", "a", "b"]
    assert [tuple(r)[1:] for r in got.collect()] == [(3, 0), (0, 10)]


def test_paging(spark):
    df = spark.range(5000).select(
        F.col("id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 97).cast("decimal(18,6)"))).alias("created_at"),
    )
    want = [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for offset in (0, 49, 2500, 4990, 6000):
        shallow = [r.id for r in paging.newest_page(df, 100, offset).collect()]
        deep = [r.id for r in paging.newest_page(df, 100, offset, shallow=0).collect()]
        assert shallow == deep == want[offset : offset + 100]
    got, cursor = [], None
    for _ in range(12):
        page = paging.newest_page_after(df, cursor, 500).collect()
        got += [r.id for r in page]
        if page:
            cursor = (page[-1].created_at, page[-1].id)
    assert got == want
    with pytest.raises(ValueError):
        paging.newest_page(df, 501)
    info = paging.page_info(usage.filtered_count(df), 50, 99).head()
    assert (info.total, info.page_no, info.has_prev, info.has_next) == (5000, 100, True, False)


def attempt_log(*outcomes):
    return [(1, i + 1, *o) for i, o in enumerate(outcomes)]


@pytest.mark.parametrize(
    "log_rows,want",
    [
        ([(0, "p", "server"), (0, "p", "server"), (0, "p", "server"), (1, "q", "ok")], ("ok", "q", None, 4, 1, 3.0)),
        ([(0, "p", "auth"), (1, "q", "ok")], ("error", "p", "auth", 1, 0, 0.0)),
        ([(0, "p", "server"), (1, "q", "timeout")], ("error", "q", "timeout", 2, 1, 0.0)),
        ([(0, "p", "other"), (1, "q", "ok"), (1, "q", "server")], ("ok", "q", None, 2, 1, 0.0)),
        ([(0, "p", "rate_limit"), (0, "p", "ok")], ("ok", "p", None, 2, 0, 1.0)),
    ],
)
def test_attempts(spark, log_rows, want):
    df = spark.createDataFrame(attempt_log(*log_rows), "request_id bigint, attempt_no int, provider_ord int, provider string, outcome string")
    assert tuple(attempts.resolve_attempts(df).head())[1:] == want


def test_requests_are_validated(spark):
    bodies = [
        '{"model":"m","messages":[]}', '{"messages":[]}', '{"model":"m"}', '{"model":"m","messages":[{"role":"tool","content":"x"}]}',
        '{"model":"m","messages":[{"role":"user"}]}', "{bad", '{"model":"m","messages":[{"role":"user","content":"né"}],"top_p":0.5,"user":"u"}',
        '{"model":"m","messages":[{"content":"x"}]}',
    ]
    ok, bad = documents.parse_requests(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"))
    assert {r.id: r.problem for r in bad.collect()} == {
        1: "model missing", 2: "messages missing", 3: "bad role", 4: "content missing", 5: "malformed", 7: "bad role",
    }
    got = {r.id: r for r in ok.collect()}
    assert set(got) == {0, 6} and got[0].messages == [] and got[6].user == "u" and got[6].top_p == 0.5


def test_inputs(spark):
    docs = ['"one"', '["a","b"]', "[]", "7", "[" + ",".join(['"x"'] * 101) + "]"]
    rows, bad = inputs.explode_inputs(spark.createDataFrame(list(enumerate(docs)), "id int, input string"))
    assert {(r.id, r.pos, r.text) for r in rows.collect()} == {(0, 0, "one"), (1, 0, "a"), (1, 1, "b")}
    assert {r.id: r.problem for r in bad.collect()} == {2: "input empty", 3: "malformed", 4: "too many inputs"}


def test_tables_round_trip(spark, tmp_path):
    at = datetime(2024, 1, 1)
    response = ("r", "m", "p", [(0, ("assistant", "hi"), "stop")], (1, 2, 3))
    data = [
        (schemas.KEYS, tables.load_keys, (1, "n", "k", None, True, None, at, None)),
        (schemas.RESPONSES, tables.load_responses, ("h", "m", [("user", "q")], response, 1, 2, at, None)),
        (schemas.ENTRIES, tables.load_entries, (1, "h", [0.5, 0.25], "q", "m", at)),
        (schemas.JOBS, tables.load_jobs, (1, 1, "batch_embeddings", "pending", "{}", None, None, at, None, None)),
    ]
    for i, (schema, load, values) in enumerate(data):
        df = spark.createDataFrame([values], schema)
        df.write.parquet(str(tmp_path / str(i)))
        assert load(spark, str(tmp_path / str(i))).collect() == df.collect()


def test_stores(spark):
    old = spark.createDataFrame([("a", "m0")], "request_hash string, model string")
    at = [datetime(2024, 1, 1, h) for h in range(3)]
    new = spark.createDataFrame([("a", "m1", at[0]), ("b", "late", at[2]), ("b", "early", at[1])], "request_hash string, model string, created_at timestamp_ntz")
    got = {(r.request_hash, r.model) for r in stores.upsert_responses(old, new).collect()}
    assert got == {("a", "m0"), ("b", "early")}


def test_quality(spark):
    df = spark.createDataFrame([(1, "none", 1), (1, "bad", 2), (2, None, None)], "id bigint, cache_hit string, key bigint")
    parent = spark.createDataFrame([(1,)], "id bigint")
    rules = quality.Rules(
        not_null=["cache_hit"], max_length={"cache_hit": 3}, domain={"cache_hit": ["none"]}, unique=["id"], foreign={"key": parent}
    )
    got = {r.check: r.violations for r in quality.quality_report(df, rules).collect()}
    assert got == {"not_null:cache_hit": 1, "max_length:cache_hit": 1, "domain:cache_hit": 1, "unique:id": 1, "foreign:key": 1}


def test_key_ledger(spark):
    d = lambda n: datetime(2024, 1, n)
    events = [(1, "create", "a", True, d(1)), (1, "revoke", None, None, d(3)), (1, "revoke", None, None, d(5)), (2, "create", "b", False, d(4))]
    df = spark.createDataFrame(events, "key_id bigint, action string, name string, is_admin boolean, ts timestamp_ntz")
    now = {r.key_id: (r.name, r.revoked_at, r.active) for r in keys.key_snapshot(df).collect()}
    assert now == {1: ("a", d(3), False), 2: ("b", None, True)}
    then = {r.key_id: r.active for r in keys.key_snapshot(df, "2024-01-02").collect()}
    assert then == {1: True}


def test_filters(spark):
    u = log(spark, row("2024-01-24 00:00:00", key=1), row("2024-01-23 00:00:00", key=2), row(NOW, key=2))
    assert filters.between_ts(u, as_of=NOW).count() == 2
    assert filters.maybe_eq(u, "api_key_id").count() == 3 and filters.maybe_eq(u, "api_key_id", 2).count() == 2
    with pytest.raises(ValueError):
        filters.between_ts(u)


def test_stored_sketches_merge_for_any_grouping(spark, tmp_path):
    rows = [(i, i % 3, ("openai", "gemini")[i % 2], "success" if i % 10 else "error", i % 500, f"2024-01-{1 + i % 4:02d} {i % 24:02d}:00:00") for i in range(4000)]
    log = spark.createDataFrame(rows, "id bigint, api_key_id bigint, provider string, status string, latency_ms int, created_at string")
    log = log.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    usage.write_sketches(log, str(tmp_path / "s"))
    usage.write_sketches(log.filter("day(created_at) = 2"), str(tmp_path / "s"))  # again: the other days stay
    stored = spark.read.parquet(str(tmp_path / "s"))
    ok = [r for r in rows if r[3] == "success"]
    for by, of in ((["provider"], lambda r: r[2]), (["api_key_id"], lambda r: r[1]), (["day"], lambda r: r[5][:10])):
        found = {str(r[0]): r for r in usage.latency_from_rollup(stored, by).collect()}
        groups = {}
        for r in ok:
            groups.setdefault(str(of(r)), []).append(r[4])
        assert set(found) == set(groups)
        for g, values in groups.items():
            assert found[g]["requests"] == len(values)
            for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
                below, upto = (sum(f(v, found[g][name]) for v in values) / len(values) for f in (int.__lt__, int.__le__))
                assert below - 0.02 <= q <= upto + 0.02
