"""Registered queries over order-dependent replays, with recursive SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import millis
from ..operators import exact_cache, ratelimit, timeline
from ..sources.driver_views import base, view, with_views
from .request_catalog import _hashes

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None, *views):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


MS = "epoch_us({c})//1000"


def flat(s, d):
    return view(s, d, "requests_flat")


# rate limits ---------------------------------------------------------------------------------


def limit_sql(key, short_ms, long_ms, short_limit, long_limit, names, source, join=""):
    """Recursive replay: one step per request of a key, the state is the list of accepted times."""
    decide = """case when {ps}>0 and len(list_filter(live, lambda x: x > ms - {sm})) >= {ps} then 'short'
        when {pl}>0 and len(live) >= {pl} then 'long' else 'ok' end""".format(
        ps="ps", pl="pl", sm=short_ms
    )
    short_name, long_name = names
    return f"""with recursive r as (
      select e.id, {key} as key, {MS.format(c='e.ts')} as ms, {short_limit} as ps, {long_limit} as pl,
        row_number() over (partition by {key} order by {MS.format(c='e.ts')}, e.id) as rn
      from {source} e {join}),
    s as (
      select key, rn, id, ms, ps, pl, [ms] as acc, 'ok' as decision from r where rn=1
      union all
      select key, rn, id, ms, ps, pl, case when d='ok' then list_append(live, ms) else live end, d from (
        select *, {decide} as d from (
          select r.key, r.rn, r.id, r.ms, r.ps, r.pl, list_filter(s.acc, lambda x: x > r.ms - {long_ms}) as live
          from s join r on r.key=s.key and r.rn=s.rn+1) a) b)
    select id, decision, cast(case decision when 'short' then {short_ms // 1000} when 'long' then {long_ms // 1000} end as int) as retry_after,
      case decision when 'short' then concat('rate limit exceeded: ', ps, '/{short_name}')
        when 'long' then concat('rate limit exceeded: ', pl, '/{long_name}') end as detail
    from s"""


OUT = ["id", "decision", "retry_after", "detail"]
add(
    "rate_limit_by_type",
    lambda s, d: ratelimit.replay_rate_limit(
        flat(s, d), key="event_type", short_seconds=3600, per_short=4, per_long=50
    ).select(*OUT),
    limit_sql("e.event_type", 3_600_000, 86_400_000, 4, 50, ("3600s", "day"), "requests_flat"), "requests_flat",
)
add(
    "rate_limit_by_key",
    lambda s, d: ratelimit.replay_rate_limit(
        flat(s, d), ratelimit.key_limits(view(s, d, "api_keys"), 1, 2)
    ).select(*OUT),
    limit_sql(
        "e.api_key_id", 60_000, 86_400_000,
        "coalesce(cast(json_extract(k.rate_limit_overrides,'$.per_minute') as int),1)",
        "coalesce(cast(json_extract(k.rate_limit_overrides,'$.per_day') as int),2)",
        ("minute", "day"), "requests_flat", "left join api_keys k on k.id=e.api_key_id",
    ),
    "requests_flat", "api_keys",
)
add(
    "rate_limit_decisions",
    lambda s, d: ratelimit.replay_rate_limit(
        flat(s, d), key="event_type", short_seconds=3600, per_short=4, per_long=50
    ).groupBy("event_type", "decision").agg(F.count("*").alias("n")),
    "with x as (" + limit_sql("e.event_type", 3_600_000, 86_400_000, 4, 50, ("3600s", "day"), "requests_flat")
    .replace("from s\"\"\"", "") + ") select r.event_type, x.decision, count(*) as n from x join requests_flat r using (id) group by 1,2",
    "requests_flat",
)
add(
    # every key is treated as a hot one: cut into islands at calm windows, replayed island by island
    "rate_limit_by_islands",
    lambda s, d: ratelimit.replay_rate_limit(
        flat(s, d), key="event_type", short_seconds=3600, per_short=4, per_long=90, hot_rows=0
    ).select(*OUT),
    limit_sql("e.event_type", 3_600_000, 86_400_000, 4, 90, ("3600s", "day"), "requests_flat"), "requests_flat",
)
add(
    "sliding_counts_minute",
    lambda s, d: timeline.sliding_counts(flat(s, d), 3600, key="event_type").select("id", "in_window"),
    f"""select id, count(*) over (partition by event_type order by {MS.format(c='ts')}
        range between 3599999 preceding and current row) as in_window from requests_flat""", "requests_flat",
)
add(
    "sliding_counts_day",
    lambda s, d: timeline.sliding_counts(flat(s, d), 86400).select("id", "in_window"),
    f"""select id, count(*) over (partition by api_key_id order by {MS.format(c='ts')}
        range between 86399999 preceding and current row) as in_window from requests_flat""", "requests_flat",
)
add(
    "limiter_islands",
    lambda s, d: timeline.limiter_islands(flat(s, d), 43200).select("id", "api_key_id", "island"),
    f"""with g as (select id, api_key_id, {MS.format(c='ts')} as ms, case when {MS.format(c='ts')} - lag({MS.format(c='ts')}) over
        (partition by api_key_id order by {MS.format(c='ts')}, id) >= 43200000 then 1 else 0 end as st from requests_flat)
    select id, api_key_id, cast(sum(st) over (partition by api_key_id order by ms, id) as bigint) as island from g""",
    "requests_flat",
)

# exact cache ---------------------------------------------------------------------------------


def cache_sql(key, ttl_ms, fillable, source, pre=""):
    return f"""with recursive {pre} r as (
      select e.id, {key} as key, {MS.format(c='e.ts')} as ms, {fillable} as f,
        row_number() over (partition by {key} order by {MS.format(c='e.ts')}, e.id) as rn from {source} e),
    s as (
      select key, rn, id, ms, f as is_fill, case when f then ms end as last_ms, case when f then id end as last_id,
        cast(null as bigint) as fill_id from r where rn=1
      union all
      select key, rn, id, ms, f and not hit, case when f and not hit then ms else last_ms end,
        case when f and not hit then id else last_id end, case when hit then last_id end from (
        select r.*, s.last_ms, s.last_id, coalesce(r.ms - s.last_ms < {ttl_ms}, false) as hit
        from s join r on r.key=s.key and r.rn=s.rn+1) a)
    select id, case when fill_id is not null then 'exact' else 'none' end as cache_hit, is_fill, fill_id from s"""


CACHE_OUT = ["id", "cache_hit", "is_fill", "fill_id"]
add(
    "exact_cache",
    lambda s, d: exact_cache.replay_exact_cache(flat(s, d), 86400, key="k", fillable="fillable").select(*CACHE_OUT),
    cache_sql("e.k", 86_400_000, "e.fillable", "requests_flat"), "requests_flat",
)
add(
    "exact_cache_hour",
    lambda s, d: exact_cache.replay_exact_cache(flat(s, d), key="event_type").select(*CACHE_OUT),
    cache_sql("e.event_type", 3_600_000, "true", "requests_flat"), "requests_flat",
)


add(
    # every key is treated as a hot one: its chain is followed by composed transfer functions
    "exact_cache_composed",
    lambda s, d: exact_cache.replay_exact_cache(flat(s, d), 43200, key="event_type", fillable="fillable", hot_rows=0).select(*CACHE_OUT),
    cache_sql("e.event_type", 43_200_000, "e.fillable", "requests_flat"), "requests_flat",
)


DELAY = "e.k*60000"


def _delayed(s, d):
    rows = flat(s, d).withColumn("delay", F.col("k") * 60_000)
    out = exact_cache.replay_exact_cache_delayed(rows, "delay", 7200, key="event_type", fillable="fillable")
    return out.select("id", "cache_hit", "is_fill")


add(
    "exact_cache_delayed", _delayed,
    f"""with recursive r as (
      select e.id, e.event_type as key, {MS.format(c='e.ts')} as ms, e.fillable as f, {DELAY} as delay,
        row_number() over (partition by e.event_type order by {MS.format(c='e.ts')}, e.id) as rn from requests_flat e),
    s as (
      select key, rn, id, f as is_fill, false as hit, case when f then [ms + delay] else cast([] as bigint[]) end as sets
      from r where rn=1
      union all
      select key, rn, id, f and not hit, hit, case when f and not hit then list_append(live, ms + delay) else live end from (
        select r.key, r.rn, r.id, r.f, r.ms, r.delay, list_filter(s.sets, lambda x: x > r.ms - 7200000) as live,
          len(list_filter(s.sets, lambda x: x > r.ms - 7200000 and x < r.ms)) > 0 as hit
        from s join r on r.key=s.key and r.rn=s.rn+1) a)
    select id, case when hit then 'exact' else 'none' end as cache_hit, is_fill from s""", "requests_flat",
)


def _by_hash(s, d):
    rows = flat(s, d).join(_hashes(s, d), "id")
    return exact_cache.replay_exact_cache(rows, 86400, fillable="fillable").select(*CACHE_OUT)


add(
    "exact_cache_by_hash", _by_hash,
    cache_sql("(e.conv_id, e.model, coalesce(e.temperature,-1))", 86_400_000, "e.fillable", "requests_flat"), "requests_flat",
)


def _asof(s, d):
    rows = flat(s, d)
    fills = rows.filter(F.col("event_type") == "purchase").select("k", F.col("ts").alias("fill_ts"))
    return timeline.asof_fill(rows.select("id", "k", "ts"), fills, 86400, key="k").select("id", "k", "fill_ms", "alive")


add(
    "asof_fill", _asof,
    f"""with r as (select id, k, {MS.format(c='ts')} as ms, event_type from requests_flat),
    f as (select distinct k, ms as fill_ms from r where event_type='purchase')
    select r.id, r.k, f.fill_ms, coalesce(r.ms - f.fill_ms < 86400000, false) as alive
    from r asof left join f on r.k=f.k and r.ms >= f.fill_ms""", "requests_flat",
)
