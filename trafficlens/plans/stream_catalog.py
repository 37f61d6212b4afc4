"""Registered queries: streams drained over the given tables, sinks, and composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..operators import usage
from ..session import scratch_path
from ..sources import documents, driver_views as dv, schemas, tables
from ..sources.driver_views import base, view, with_views
from ..streaming import live, replays
from . import reports, usage_catalog as uc
from .replay_catalog import cache_sql, limit_sql

#: Micro-batches that a streamed table arrives in.
PARTS = 3
QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None, *views):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


def stream_table(spark, d, name, arrival=lambda part: part):
    """A given table as a file stream that takes several micro-batches, in the order of its first time column.

    ``arrival`` gives the part that rows come in, from the part their time lies in.

    Each part is dealt over as many files as the table has partitions, and a micro-batch takes just
    that many files: a part. Rows without a time come first.
    """
    table = base(spark, d, name)
    at = next((c for c, t in table.dtypes if t.startswith("timestamp") or t == "date"), None)
    if at is None:
        return spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    lo, hi = (F.lit(x) for x in table.agg(F.min(at), F.max(at)).first())
    part = lambda x: F.floor((F.unix_micros(x.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) * PARTS / (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp")) + 1))
    path = scratch_path(spark, f"stream_{name}")
    files = table.rdd.getNumPartitions()
    for i in range(PARTS):
        table.filter(arrival(F.coalesce(part(F.col(at)), F.lit(0))) == i).repartition(files).write.mode("append").parquet(path)
        # a part of few rows may leave files out; files without rows keep the next part out of its batch
        for _ in range((i + 1) * files - len(spark.read.schema(table.schema).parquet(path).inputFiles())):
            table.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_view(spark, d, name, streamed, **how):
    """A view whose table ``streamed`` arrives as a stream."""
    text = dv.VIEWS[name]
    frames = {
        t: stream_table(spark, d, t, **how) if t == streamed else base(spark, d, t) for t in dv.tables_of(text)
    }
    return spark.sql(text, **frames)


def usage_stream(s, d):
    return stream_view(s, d, "usage_logs", "events")


# streams -------------------------------------------------------------------------------------
add(
    "stream_rpm", lambda s, d: live.drain_updates(live.stream_rpm(usage_stream(s, d)), ["minute"], "rpm"),
    "select date_trunc('minute', created_at) as minute, count(*) as count from usage_logs group by 1", "usage_logs",
)
add(
    "stream_hourly", lambda s, d: live.drain_updates(live.stream_hourly(usage_stream(s, d)), ["hour"], "hourly"),
    """select date_trunc('hour', created_at) as hour, count(*) as total,
      count(*) filter (where cache_hit='none') as "none", count(*) filter (where cache_hit='exact') as exact,
      count(*) filter (where cache_hit='semantic') as semantic, count(*) filter (where status='error') as errors,
      count(*) filter (where status='rate_limited') as rate_limited from usage_logs group by 1""", "usage_logs",
)
add(
    "stream_latency",
    lambda s, d: usage.within_rank(
        view(s, d, "usage_logs").filter("status = 'success'").select(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), "latency_ms"),
        live.drain_updates(live.stream_latency(usage_stream(s, d)), ["hour"], "latency"), "hour",
    ),
    """select date_trunc('hour', created_at) as hour, true as p50, true as p95, true as p99
      from usage_logs where status='success' group by 1""", "usage_logs",
)
add(
    "stream_counters", lambda s, d: live.live_counters(usage_stream(s, d), view(s, d, "api_keys")),
    uc.METRIC_SQL, "usage_logs", "api_keys",
)
add(
    "stream_dedupe",
    lambda s, d: live.drain_rows(live.stream_dedupe(usage_stream(s, d).unionByName(usage_stream(s, d)), "40 days"), "dedupe")
    .select("id", "request_id", "status"),
    "select id, request_id, status from usage_logs", "usage_logs",
)
add(
    "stream_jobs",
    lambda s, d: live.live_jobs(stream_view(s, d, "job_events", "orders"))
    .select("job_id", "status", "created_at", "started_at", "finished_at"),
    """select job_id, arg_max(status, (ts, case status when 'pending' then 0 when 'running' then 1 else 2 end)) as status,
      min(ts) filter (where status='pending') as created_at, min(ts) filter (where status='running') as started_at,
      max(ts) filter (where status in ('succeeded','failed')) as finished_at from job_events group by 1""",
    "job_events",
)

#: Seconds after which a row is late; every seventh row arrives one part late.
LATE = 7200
BEHIND = 7


def _punctual(s, d):
    path = scratch_path(s, "punctual")
    behind = (F.col("event_id") % BEHIND == 0).cast("int")
    rows = stream_view(s, d, "usage_logs", "events", arrival=lambda part: F.least(F.lit(PARTS - 1), part + behind))
    minute = F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("minute")
    count = lambda df: df.groupBy(minute).agg(F.count("*").alias("on_time"))
    live.write_punctual(rows, path, count, ["minute"], 60, LATE).awaitTermination()
    on_time = live.totals(s, path, ["minute"]).withColumn("late", F.lit(0).cast("bigint"))
    late = live.late_rows(s, path).groupBy(minute).agg(F.lit(0).cast("bigint").alias("on_time"), F.count("*").alias("late"))
    return on_time.unionByName(late).groupBy("minute").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


add(
    "stream_rpm_late", _punctual,
    f"""with ends as (select min(epoch_us(created_at)) as lo, max(epoch_us(created_at)) as hi from usage_logs),
    parts as (select created_at, date_trunc('minute', created_at) as minute,
      least({PARTS - 1}, coalesce(cast(floor((epoch_us(created_at) - lo) * {PARTS} / (hi - lo + 1)) as int), 0)
        + case when id % {BEHIND} = 0 then 1 else 0 end) as part from usage_logs, ends),
    seen as (select x.part, max(y.created_at) as seen from (select distinct part from parts) x
      left join parts y on y.part < x.part group by 1)
    select minute, count(*) filter (where not late) as on_time, count(*) filter (where late) as late from (
      select minute, minute is null or coalesce(epoch_ms(minute) + 60000 <= epoch_ms(seen) - {LATE * 1000}, false) as late
      from parts join seen using (part)) z group by 1""",
    "usage_logs",
)


def _stream_cache(s, d):
    path = scratch_path(s, "exact")
    rows = stream_view(s, d, "requests_flat", "events").select("id", "ts", "k", "fillable")
    replays.stream_exact_cache(rows, path, 86400, key="k", fillable="fillable").awaitTermination()
    return replays.rows_of(s, path).select("id", "cache_hit", "is_fill", "fill_id")


add("stream_exact_cache", _stream_cache, cache_sql("e.k", 86_400_000, "e.fillable", "requests_flat"), "requests_flat")


def _stream_limits(s, d):
    path = scratch_path(s, "limits")
    rows = stream_view(s, d, "requests_flat", "events").select("id", "ts", "event_type")
    replays.stream_rate_limit(
        rows, path, key="event_type", short_seconds=3600, per_short=4, per_long=50
    ).awaitTermination()
    return replays.rows_of(s, path).select("id", "decision", "retry_after", "detail")


add(
    "stream_rate_limit", _stream_limits,
    limit_sql("e.event_type", 3_600_000, 86_400_000, 4, 50, ("3600s", "day"), "requests_flat"), "requests_flat",
)

# sinks ---------------------------------------------------------------------------------------


def _append(s, d):
    path = scratch_path(s, "usage")
    tables.append_usage(uc.u(s, d), path)
    return tables.load_usage(s, path, "2024-01-05 00:00:00", uc.AS_OF).withColumn("cost_usd", F.round("cost_usd", 9))


add(
    "append_usage", _append,
    f"""select * replace (round(cost_usd,9) as cost_usd) from usage_logs
        where created_at >= timestamp '2024-01-05 00:00:00' and created_at <= timestamp '{uc.AS_OF}'""", "usage_logs",
)


def _stored(spark, df, schema, load, name):
    """Write ``df`` in a table's schema and scan it back."""
    path = scratch_path(spark, name)
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(path)
    return load(spark, path)


def _entries(s, d):
    df = base(s, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.md5(F.col("vec_id").cast("string")).alias("request_hash"), "embedding",
        F.lit("").alias("prompt_text"), F.col("label").cast("string").alias("model"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    out = _stored(s, df, schemas.ENTRIES, tables.load_entries, "entries")
    return out.select("id", "request_hash", "model", "created_at", F.size("embedding").alias("dim"))


add(
    "entries_scan", _entries,
    """select vec_id as id, md5(cast(vec_id as varchar)) as request_hash, cast(label as varchar) as model,
      timestamp '2024-01-01 00:00:00' as created_at, cast(len(embedding) as int) as dim from embeddings""",
)


def _responses(s, d):
    docs = documents.parse_responses(view(s, d, "response_docs"))
    df = docs.select(
        F.md5(F.col("id").cast("string")).alias("request_hash"), F.col("response.model").alias("model"),
        F.lit(None).cast(schemas.MESSAGES).alias("messages"), "response",
        F.col("response.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("response.usage.completion_tokens").alias("completion_tokens"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )
    out = _stored(s, df, schemas.RESPONSES, tables.load_responses, "responses")
    return out.select(
        "request_hash", "model", "prompt_tokens", "completion_tokens", F.size("response.choices").alias("choices"),
        F.col("response.id").alias("response_id"),
    )


add(
    "responses_scan", _responses,
    """select md5(cast(id as varchar)) as request_hash, doc->>'$.model' as model,
      coalesce(cast(doc->>'$.usage.prompt_tokens' as int),0) as prompt_tokens,
      coalesce(cast(doc->>'$.usage.completion_tokens' as int),0) as completion_tokens,
      cast(json_array_length(doc->'$.choices') as int) as choices, doc->>'$.id' as response_id
    from (select id, cast(body as json) as doc from response_docs) x""", "response_docs",
)
add(
    "jobs_scan", lambda s, d: _stored(s, view(s, d, "jobs"), schemas.JOBS, tables.load_jobs, "jobs"),
    "select id, api_key_id, kind, status, input, result, error, created_at, started_at, finished_at from jobs", "jobs",
)


def _rollup(s, d):
    path = scratch_path(s, "rollup")
    rows = uc.u(s, d)
    usage.write_rollup(rows, path)
    # a second run over one week replaces that week and leaves the rest
    usage.write_rollup(rows.filter(F.to_date("created_at").between("2024-01-08", "2024-01-14")), path)
    return s.read.parquet(path).groupBy("day").agg(
        F.sum("requests").alias("requests"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost_usd"), 8).alias("cost_usd")
    )


add(
    "write_rollup", _rollup,
    """select cast(created_at as date) as day, count(*) as requests, cast(sum(total_tokens) as bigint) as tokens,
      round(sum(cost_usd),8) as cost_usd from usage_logs group by 1""", "usage_logs",
)

# composite reports ---------------------------------------------------------------------------
HOUR_PROVIDER = """select date_trunc('hour', created_at) as hour, provider, count(*) as requests,
  count(*) filter (where status='error') as errors,
  round(count(*) filter (where cache_hit<>'none')/cast(count(*) as double),6) as hit_rate,
  cast(floor(round(coalesce(percentile_cont(0.95) within group (order by latency_ms) filter (where status='success'),0),6)) as bigint) as p95_ms,
  round(coalesce(sum(cost_usd),0),8) as cost_usd from usage_logs group by 1,2"""
add("provider_hourly", lambda s, d: reports.provider_hourly(uc.u(s, d)), HOUR_PROVIDER, "usage_logs")


def overview_sql(hours, recent):
    w, m = uc.window(hours), uc.window(recent)
    iso = "strftime(date_trunc('{u}', created_at), '%Y-%m-%dT%H:%M:%S.%f')"
    item = "select '{s}' as section, {l} as label, '{m}' as metric, round(cast({v} as double),8) as value from usage_logs where {w}"
    parts = [
        item.format(s="totals", l="''", m="requests", v="count(*)", w=w),
        item.format(s="totals", l="''", m="cost_usd", v="coalesce(sum(cost_usd),0)", w=w),
        item.format(s="totals", l="''", m="tokens", v="coalesce(sum(total_tokens),0)", w=w),
        item.format(s="totals", l="''", m="hits", v="count(*) filter (where cache_hit<>'none')", w=w),
        item.format(
            s="totals", l="''", m="p95_latency_ms",
            v="floor(round(coalesce(percentile_cont(0.95) within group (order by latency_ms),0),6))", w=w + " and status='success'",
        ),
        item.format(s="per_minute", l=iso.format(u="minute"), m="count", v="count(*)", w=m) + " group by 2",
    ]
    for layer in S.CACHE_LAYERS:
        v = f"count(*) filter (where cache_hit='{layer}')"
        parts.append(item.format(s="breakdown", l="''", m=layer, v=v, w=w))
        parts.append(item.format(s="cache_hourly", l=iso.format(u="hour"), m=layer, v=v, w=w) + " group by 2")
    return "\nunion all\n".join(parts)


add("overview", lambda s, d: reports.overview(uc.u(s, d), uc.AS_OF, uc.MONTH, uc.MONTH), overview_sql(uc.MONTH, uc.MONTH), "usage_logs")
add("overview_24h", lambda s, d: reports.overview(uc.u(s, d), uc.AS_OF), overview_sql(24, 1), "usage_logs")
add(
    "overview_row", lambda s, d: reports.overview_totals_row(uc.u(s, d), uc.AS_OF, uc.MONTH),
    f"""select count(*) as requests, round(coalesce(sum(cost_usd),0),8) as cost_usd,
      cast(coalesce(sum(total_tokens),0) as bigint) as tokens,
      round(count(*) filter (where cache_hit<>'none')/cast(count(*) as double),6) as cache_hit_rate,
      cast(floor(round(percentile_cont(0.95) within group (order by latency_ms) filter (where status='success'),6)) as bigint) as p95_latency_ms
      from usage_logs where {uc.window(uc.MONTH)}""", "usage_logs",
)


def _explorer(s, d, part):
    return reports.usage_explorer(uc.u(s, d), "2024-01-01", uc.AS_OF, limit=100, offset=50)[part]


add(
    "usage_explorer_summary", lambda s, d: _explorer(s, d, "summary"),
    f"""select day, count(*) as requests, cast(coalesce(sum(total_tokens),0) as bigint) as tokens,
      round(coalesce(sum(cost_usd),0),8) as cost_usd, cast(floor(round(coalesce(avg(latency_ms),0),6)) as bigint) as avg_latency_ms,
      grouping(day)=1 as is_total
      from (select *, cast(created_at as date) as day from usage_logs where created_at between timestamp '2024-01-01 00:00:00'
        and timestamp '{uc.AS_OF}') x group by rollup(day)""", "usage_logs",
)
add(
    "usage_explorer_rows", lambda s, d: _explorer(s, d, "rows").select("id", "request_id", "api_key_id", "created_at"),
    f"""select id, request_id, cast(api_key_id as varchar) as api_key_id, {uc.ISO.format(c='created_at')} as created_at
      from (select * from usage_logs where created_at between timestamp '2024-01-01 00:00:00' and timestamp '{uc.AS_OF}'
      order by created_at desc, id desc limit 100 offset 50) x""", "usage_logs",
)
add(
    "jobs_report_rows", lambda s, d: reports.jobs_report(view(s, d, "jobs"), "succeeded")["rows"].select("id", "status", "created_at"),
    f"""select cast(id as varchar) as id, status, {uc.ISO.format(c='created_at')} as created_at from (
      select * from jobs where status='succeeded' order by created_at desc, id desc limit 50) x""", "jobs",
)
add(
    "jobs_report_total", lambda s, d: reports.jobs_report(view(s, d, "jobs"), "succeeded")["total"],
    "select count(*) as total from jobs where status='succeeded'", "jobs",
)
