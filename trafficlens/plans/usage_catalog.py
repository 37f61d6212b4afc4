"""Registered queries over usage, keys and metrics, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import credentials, display, errors, numbers, times
from ..functions.times import bucket
from ..operators import filters, keys, metrics, paging, quality, usage
from ..operators.accounting import with_cost as price
from ..session import scratch_path
from ..sources.driver_views import base, view, with_views
from ..sources.tables import pricing_df

AS_OF = "2024-01-31 00:00:00"
MONTH = 24 * 31  # look-back in hours that covers the whole events table

QUERIES: dict = {}
ORACLES: dict = {}

U, K, J = "usage_logs", "api_keys", "jobs"


PRICE_VALUES = ", ".join(f"('{p}','{m}',cast({a!r} as double),cast({b!r} as double))" for p, m, a, b in S.PRICES)


def add(name, fn, sql=None, *views):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


def u(spark, d):
    return view(spark, d, U)


def k(spark, d):
    return view(spark, d, K)


def window(hours, alias=""):
    c = f"{alias}created_at"
    return f"{c} >= timestamp '{AS_OF}' - interval '{hours}' hour and {c} <= timestamp '{AS_OF}'"


def money(expr):
    return f"round(coalesce({expr}, 0), 8)"


# scans ---------------------------------------------------------------------------------------
add(
    "usage_scan",
    lambda s, d: u(s, d).withColumn("cost_usd", F.round("cost_usd", 9)),
    f"select * replace (round(cost_usd, 9) as cost_usd) from {U}", U,
)
add("keys_scan", k, f"select * from {K}", K)
# overview parts, each over the whole log and over its usual window ---------------------------
REPORTS = {
    "overview_totals": (
        usage.overview_totals,
        f"""select count(*) as requests, {money('sum(cost_usd)')} as cost_usd,
            cast(coalesce(sum(total_tokens),0) as bigint) as tokens from {U} where {{w}}""",
        24,
    ),
    "cache_breakdown": (
        usage.cache_breakdown,
        f"""select count(*) filter (where cache_hit='none') as "none",
            count(*) filter (where cache_hit='exact') as exact,
            count(*) filter (where cache_hit='semantic') as semantic from {U} where {{w}}""",
        24,
    ),
    "cache_hit_rate": (
        usage.cache_hit_rate,
        f"""select round(coalesce(count(*) filter (where cache_hit<>'none') / nullif(cast(count(*) as double),0),0),6)
            as cache_hit_rate from {U} where {{w}}""",
        24,
    ),
    "p95_latency": (
        usage.p95_latency,
        f"""select cast(floor(round(coalesce(percentile_cont(0.95) within group (order by latency_ms),0),6)) as bigint)
            as p95_latency_ms from {U} where status='success' and {{w}}""",
        24,
    ),
    "latency_hourly": (
        usage.latency_hourly,
        f"""select date_trunc('hour', created_at) as t, """ + ", ".join(
            f"cast(floor(round(percentile_cont({q}) within group (order by latency_ms),6)) as bigint) as {n}"
            for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
        ) + f""" from {U} where status='success' and {{w}} group by 1""",
        24,
    ),
    "errors_hourly": (
        usage.errors_hourly,
        f"""select date_trunc('hour', created_at) as t, count(*) filter (where status='error') as errors,
            count(*) filter (where status='rate_limited') as rate_limited, count(*) as total,
            round(count(*) filter (where status='error') / cast(count(*) as double), 6) as error_rate
            from {U} where {{w}} group by 1""",
        24,
    ),
    "requests_per_minute": (
        usage.requests_per_minute,
        f"select date_trunc('minute', created_at) as minute, count(*) as count from {U} where {{w}} group by 1",
        1,
    ),
    "cache_hourly": (
        usage.cache_hourly,
        f"""select date_trunc('hour', created_at) as hour, count(*) filter (where cache_hit='none') as "none",
            count(*) filter (where cache_hit='exact') as exact,
            count(*) filter (where cache_hit='semantic') as semantic from {U} where {{w}} group by 1""",
        24,
    ),
    "rate_limit_hourly": (
        usage.rate_limit_hourly,
        f"""select date_trunc('hour', created_at) as t, count(*) as rejections from {U}
            where status='rate_limited' and {{w}} group by 1""",
        24,
    ),
    "latency_by_layer": (
        usage.latency_by_layer,
        f"""select cache_hit, count(*) as hits, round(count(*) / cast(sum(count(*)) over () as double), 6) as share,
            cast(floor(round(avg(latency_ms),6)) as bigint) as avg_ms,
            cast(floor(round(percentile_cont(0.5) within group (order by latency_ms),6)) as bigint) as p50_ms,
            cast(floor(round(percentile_cont(0.95) within group (order by latency_ms),6)) as bigint) as p95_ms
            from {U} where status='success' and {{w}} group by 1""",
        24,
    ),
    "cost_saved": (
        usage.cost_saved,
        f"""select hits, misses, round(coalesce(paid/nullif(misses,0),0),8) as avg_miss_cost,
            round(hits*coalesce(paid/nullif(misses,0),0),8) as cost_saved from (
            select count(*) filter (where cache_hit<>'none') as hits, count(*) filter (where cache_hit='none') as misses,
            sum(cost_usd) filter (where cache_hit='none') as paid
            from {U} where status='success' and {{w}}) x""",
        24,
    ),
}
for _name, (_fn, _sql, _hours) in REPORTS.items():
    add(_name, lambda s, d, f=_fn: f(u(s, d), AS_OF, hours=MONTH), _sql.replace("{w}", window(MONTH)), U)
    add(
        f"{_name}_{_hours}h", lambda s, d, f=_fn, h=_hours: f(u(s, d), AS_OF, hours=h),
        _sql.replace("{w}", window(_hours)), U,
    )



def _rank_error(s, d):
    """Per hour: is the share of rows at or below each approximate quantile within 1/accuracy of it?"""
    approx = usage.latency_hourly_approx(u(s, d), AS_OF, hours=MONTH)
    rows = filters.success_only(filters.since(u(s, d), AS_OF, hours=MONTH)).select(
        bucket(F.col("created_at"), "hour").alias("t"), "latency_ms"
    )
    return usage.within_rank(rows, approx, "t")


def _stored_sketches(s, d):
    """Sketches written once and merged per provider, next to the ranks of the raw rows."""
    path = scratch_path(s, "latency-sketches")
    usage.write_sketches(u(s, d), path)
    found = usage.latency_from_rollup(s.read.parquet(path), ["provider"])
    rows = filters.success_only(u(s, d)).filter("latency_ms is not null").select("provider", "latency_ms")
    near = usage.within_rank(rows, found, "provider", accuracy=50)
    return near.join(found.select("provider", "requests"), "provider")


add(
    "latency_from_rollup", _stored_sketches,
    f"""select provider, count(*) as requests, true as p50, true as p95, true as p99 from {U}
        where status='success' and latency_ms is not null group by 1""", U,
)
add(
    "latency_hourly_approx", _rank_error,
    f"select date_trunc('hour', created_at) as t, true as p50, true as p95, true as p99 from {U} where status='success' and {window(MONTH)} group by 1", U,
)
add(
    "tokens_by_provider",
    lambda s, d: usage.tokens_by_provider(u(s, d), AS_OF, days=31),
    f"""select date_trunc('day', created_at) as d, provider, cast(sum(total_tokens) as bigint) as tokens
        from {U} where provider not in ('ratelimit') and {window(MONTH)} group by 1, 2""", U,
)
add(
    "tokens_by_provider_wide",
    lambda s, d: usage.tokens_by_provider_wide(u(s, d), AS_OF, days=31),
    f"""select date_trunc('day', created_at) as d,
        cast(coalesce(sum(total_tokens) filter (where provider='gemini'),0) as bigint) as gemini,
        cast(coalesce(sum(total_tokens) filter (where provider='openai'),0) as bigint) as openai
        from {U} where provider not in ('ratelimit') and {window(MONTH)} group by 1""", U,
)
add(
    "provider_list", lambda s, d: usage.provider_list(u(s, d), AS_OF, days=31),
    f"select distinct provider from {U} where provider<>'ratelimit' and {window(MONTH)}", U,
)
COST_SQL = f"""select k.id, k.name, k.key_prefix as prefix, {money('sum(u.cost_usd)')} as cost_usd,
    cast(coalesce(sum(u.total_tokens),0) as bigint) as tokens, count(u.id) as requests
    from {K} k left join {U} u on u.api_key_id=k.id and {{w}}
    group by 1,2,3 order by cost_usd desc, k.id limit {{n}}"""
add(
    "cost_by_key", lambda s, d: keys.cost_by_key(u(s, d), k(s, d), AS_OF, days=31),
    COST_SQL.format(w=window(MONTH, "u."), n=10), U, K,
)
add(
    "cost_by_key_7d", lambda s, d: keys.cost_by_key(u(s, d), k(s, d), AS_OF),
    COST_SQL.format(w=window(168, "u."), n=10), U, K,
)
add(
    "usage_aggregate", lambda s, d: usage.usage_aggregate(u(s, d)),
    f"""select count(*) as requests, cast(coalesce(sum(total_tokens),0) as bigint) as tokens,
        {money('sum(cost_usd)')} as cost_usd, cast(floor(round(coalesce(avg(latency_ms),0),6)) as bigint) as avg_latency_ms
        from {U}""", U,
)
add(
    "usage_daily", lambda s, d: usage.usage_daily(u(s, d)),
    f"""select cast(created_at as date) as day, count(*) as requests,
        cast(coalesce(sum(total_tokens),0) as bigint) as tokens, {money('sum(cost_usd)')} as cost_usd
        from {U} group by 1""", U,
)
add(
    "usage_rollup", lambda s, d: usage.usage_rollup(u(s, d)),
    f"""select day, count(*) as requests, cast(coalesce(sum(total_tokens),0) as bigint) as tokens,
        {money('sum(cost_usd)')} as cost_usd, cast(floor(round(coalesce(avg(latency_ms),0),6)) as bigint) as avg_latency_ms,
        grouping(day)=1 as is_total
        from (select *, cast(created_at as date) as day from {U}) x group by rollup(day)""", U,
)
add(
    "rollup_daily", lambda s, d: usage.rollup_daily(u(s, d)),
    f"""select cast(created_at as date) as day, api_key_id, provider, model, status, cache_hit, count(*) as requests,
        cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
        cast(sum(total_tokens) as bigint) as total_tokens, {money('sum(cost_usd)')} as cost_usd,
        cast(sum(latency_ms) as bigint) as latency_ms_sum from {U} group by 1,2,3,4,5,6""", U,
)
add(
    "retention", lambda s, d: usage.retain(u(s, d), "2024-02-15 00:00:00", 30).select("id", "created_at"),
    f"select id, created_at from {U} where created_at >= timestamp '2024-02-15 00:00:00' - interval '30' day", U,
)
add(
    "filtered_count",
    lambda s, d: usage.filtered_count(filters.maybe_eq(filters.between_ts(u(s, d), "2024-01-05", AS_OF), "api_key_id", 3)),
    f"""select count(*) as total from {U} where created_at between timestamp '2024-01-05 00:00:00' and timestamp '{AS_OF}'
        and api_key_id=3""", U,
)
add("last_used", lambda s, d: usage_last(s, d), f"select api_key_id, max(created_at) as last_used_at from {U} group by 1", U)


def usage_last(s, d):
    return keys.last_used(u(s, d))


add(
    "traffic_mix", lambda s, d: usage.traffic_mix(u(s, d)),
    f"""select case when model='embeddings' then 'embeddings' else 'chat' end as endpoint, status, cache_hit,
        count(*) as requests, round(count(*)/cast(sum(count(*)) over () as double),6) as share from {U} group by 1,2,3""", U,
)
add(
    "preset_counts", lambda s, d: usage.preset_counts(u(s, d), AS_OF),
    "select " + ", ".join(
        f"count(*) filter (where created_at >= timestamp '{AS_OF}' - interval '{n}' day) as last_{n}d" for n in (1, 3, 7, 14, 30)
    ) + f" from {U} where created_at <= timestamp '{AS_OF}'", U,
)

# predicates and shapes -----------------------------------------------------------------------
add(
    "since_7d", lambda s, d: filters.since(u(s, d), AS_OF, days=7).select("id", "created_at"),
    f"select id, created_at from {U} where {window(168)}", U,
)
add(
    "between_default", lambda s, d: filters.between_ts(u(s, d), as_of=AS_OF).select("id", "created_at"),
    f"select id, created_at from {U} where created_at between timestamp '{AS_OF}' - interval '7' day and timestamp '{AS_OF}'", U,
)
add(
    "success_without_rejections",
    lambda s, d: filters.exclude_providers(filters.success_only(u(s, d))).select("id", "provider", "status"),
    f"select id, provider, status from {U} where status='success' and provider not in ('ratelimit')", U,
)
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"
add(
    "usage_rows", lambda s, d: filters.usage_rows(u(s, d)).withColumn("cost_usd", F.round("cost_usd", 9)),
    f"""select id, request_id, cast(api_key_id as varchar) as api_key_id, model, provider, prompt_tokens, completion_tokens,
        total_tokens, round(cost_usd,9) as cost_usd, latency_ms, cache_hit, status, error,
        {ISO.format(c='created_at')} as created_at from {U}""", U,
)
add(
    "active_keys",
    lambda s, d: filters.active_keys(k(s, d), AS_OF).select("id", "key_prefix", "is_admin"),
    f"select id, key_prefix, is_admin from {K} where revoked_at is null or revoked_at > timestamp '{AS_OF}'", K,
)
add(
    "admin_keys", lambda s, d: filters.admin_keys(filters.active_keys(k(s, d))).select("id", "name", "user_email"),
    f"select id, name, user_email from {K} where revoked_at is null and is_admin", K,
)
add(
    "display_formats",
    lambda s, d: u(s, d).select(
        "id",
        display.fmt_usd(F.round("cost_usd", 6), 5).alias("cost"),
        display.fmt_pct(F.col("prompt_tokens") / F.lit(1000.0)).alias("pct"),
        display.fmt_label(F.col("created_at"), "hour").alias("hh"),
        display.fmt_label(F.col("created_at"), "minute").alias("hhmm"),
        display.fmt_label(F.col("created_at"), "day").alias("mmdd"),
        display.dash(F.col("error")).alias("error"),
    ),
    f"""select id, printf('$%.5f', round(cost_usd,6)) as cost, printf('%.1f%%', prompt_tokens/1000.0::double*100) as pct,
        strftime(created_at,'%H') as hh, strftime(created_at,'%H:%M') as hhmm, strftime(created_at,'%m-%d') as mmdd,
        coalesce(error,'—') as error from {U}""", U,
)
add(
    "time_columns",
    lambda s, d: u(s, d).select(
        "id",
        times.bucket(F.col("created_at"), "minute").alias("minute"),
        times.to_day(F.col("created_at")).alias("day"),
        times.iso(F.col("created_at")).alias("iso"),
        times.millis(F.col("created_at")).alias("ms"),
        times.expires_at(F.col("created_at"), S.CACHE_TTL_SECONDS).alias("expires_at"),
        times.is_live(times.millis(F.col("created_at")), F.lit(1705000000000), S.CACHE_TTL_SECONDS).alias("live"),
    ),
    f"""select id, date_trunc('minute', created_at) as minute, cast(created_at as date) as day,
        {ISO.format(c='created_at')} as iso, epoch_us(created_at)//1000 as ms, created_at + interval '3600' second as expires_at,
        epoch_us(created_at)//1000 - 1705000000000 < 3600000 as live from {U}""", U,
)
add(
    "charged_cost",
    lambda s, d: with_cost(s, d),
    f"""select u.id, case when cache_hit='none' then prompt_tokens else 0 end as charged_prompt,
        case when cache_hit='none' then prompt_tokens+completion_tokens else 0 end as charged_total,
        round(coalesce(prompt_tokens/1000.0::double*p.prompt_per_1k + completion_tokens/1000.0::double*p.completion_per_1k,0),9) as cost
        from {U} u left join (values {PRICE_VALUES}) p(provider, model, prompt_per_1k, completion_per_1k)
          on u.provider=p.provider and u.model=p.model""", U,
)


def with_cost(s, d):
    rows = price(u(s, d).drop("cost_usd"), pricing_df(s), "cost")
    hit = F.col("cache_hit")
    return rows.select(
        "id",
        numbers.charged(hit, F.col("prompt_tokens")).alias("charged_prompt"),
        numbers.charged(hit, F.col("prompt_tokens") + F.col("completion_tokens")).alias("charged_total"),
        F.round("cost", 9).alias("cost"),
    )


# pages ---------------------------------------------------------------------------------------
PAGE = "id, created_at"
add(
    "usage_page", lambda s, d: paging.usage_page(u(s, d)).select("id", "created_at"),
    f"select id, {ISO.format(c='created_at')} as created_at from (select * from {U} order by created_at desc, id desc limit 50) x", U,
)
add(
    "usage_page_deep",
    lambda s, d: paging.newest_page(u(s, d), 500, 700, shallow=100).select("id", "created_at"),
    f"select {PAGE} from {U} order by created_at desc, id desc limit 500 offset 700", U,
)
add(
    "usage_page_after",
    lambda s, d: paging.usage_page_after(u(s, d), ("2024-01-20 00:00:00", 0), 500).select("id", "created_at"),
    f"""select id, {ISO.format(c='created_at')} as created_at from (
        select * from {U} where created_at < timestamp '2024-01-20 00:00:00'
        order by created_at desc, id desc limit 500) x""", U,
)
add(
    "jobs_page",
    lambda s, d: paging.jobs_page(view(s, d, J), "failed", 50, 100),
    f"""select cast(id as varchar) as id, cast(api_key_id as varchar) as api_key_id, kind, status, input, error, """
    + ", ".join(f"{ISO.format(c=c)} as {c}" for c in ("created_at", "started_at", "finished_at"))
    + f" from (select * from {J} where status='failed' order by created_at desc, id desc limit 50 offset 100) x", J,
)
add(
    "page_info", lambda s, d: paging.page_info(usage.filtered_count(u(s, d)), 50, 3),
    f"select count(*) as total, 4 as page_no, true as has_prev, 200 < count(*) as has_next from {U}", U,
)

# keys ----------------------------------------------------------------------------------------
add(
    "keys_report", lambda s, d: keys.keys_report(k(s, d), u(s, d)),
    f"""select cast(k.id as varchar) as id, name, key_prefix as prefix, user_email as email, is_admin as admin,
        rate_limit_overrides, {ISO.format(c='k.created_at')} as created_at, {ISO.format(c='revoked_at')} as revoked_at,
        {ISO.format(c='m')} as last_used_at
        from {K} k left join (select api_key_id, max(created_at) as m from {U} group by 1) x on x.api_key_id=k.id""", U, K,
)
add(
    "used_keys", lambda s, d: keys.used_keys(k(s, d), u(s, d), AS_OF, days=31).select("id", "name"),
    f"select id, name from {K} k where exists (select 1 from {U} u where u.api_key_id=k.id and {window(MONTH, 'u.')})", U, K,
)
add(
    "idle_keys", lambda s, d: keys.idle_keys(k(s, d), u(s, d), AS_OF, days=31).select("id", "name"),
    f"select id, name from {K} k where not exists (select 1 from {U} u where u.api_key_id=k.id and {window(MONTH, 'u.')})", U, K,
)
add(
    "orphan_usage", lambda s, d: keys.orphans(u(s, d), k(s, d), "api_key_id").select("id", "api_key_id"),
    f"select id, api_key_id from {U} u where not exists (select 1 from {K} k where k.id=u.api_key_id)", U, K,
)
HEADERS = """
select event_id as id, case
    when event_id%11=0 then null when event_id%11=1 then '' when event_id%11=2 then 'Basic abc'
    when event_id%11=3 then 'Bearer' when event_id%11=4 then concat('bearer  key-000007xxxx ', chr(9))
    when event_id%11=5 then 'Bearer other-000001'
    else concat('BEARER key-', lpad(cast(user_id*12 as string),6,'0'), 'secret') end as header
from {events}
"""
add(
    "resolve_keys",
    lambda s, d: keys.resolve_keys(
        s.sql(HEADERS, events=base(s, d, "events")), k(s, d), header="header",
        prefix=lambda t: credentials.key_prefix(t, "key-", 6),
    ),
    f"""with h as ({HEADERS.format(events='events')}),
    t as (select *, case when header is null or header='' then 'missing'
            when strpos(header,' ')=0 or lower(split_part(header,' ',1))<>'bearer' then 'invalid_scheme'
            else 'token' end as st,
            case when strpos(header,' ')>0 and lower(split_part(header,' ',1))='bearer'
                 then trim(substr(header, strpos(header,' ')+1), concat(' ', chr(9))) end as tok from h),
    p as (select *, case when starts_with(tok,'key-') then substr(tok,1,10) end as pre from t)
    select p.id, p.header, k.id as api_key_id,
      case when st<>'token' then st when pre is null then 'invalid_key' when k.id is null then 'unknown'
           when k.revoked_at is not null then 'revoked' else 'ok' end as resolution
    from p left join {K} k on k.key_prefix=p.pre""", K,
)
ODD_LIMITS = """
select c_custkey as id, case c_custkey%7 when 0 then '{{"per_minute":2.5,"per_day":true}}' when 1 then '{{"per_minute":"7","per_day":-1.5}}'
    when 2 then '{{"per_minute":"many","per_day":null}}' when 3 then '{{"per_minute":[1]}}' when 4 then 'broken' when 5 then '{{}}' end as o
from {customer}
"""
add(
    "odd_key_limits",
    lambda s, d: s.sql(ODD_LIMITS, customer=base(s, d, "customer")).select(
        "id",
        credentials.limit_of(F.col("o"), "per_minute", 60).alias("per_minute"),
        credentials.limit_of(F.col("o"), "per_day", 10000).alias("per_day"),
        credentials.limit_problem(F.col("o"), "per_minute").alias("problem"),
    ),
    """select c_custkey as id, case c_custkey%7 when 0 then 2 when 1 then 7 else 60 end::int as per_minute,
      case c_custkey%7 when 0 then 1 when 1 then -1 else 10000 end::int as per_day,
      case c_custkey%7 when 2 then 'many' when 3 then '[1]' end as problem from customer""",
)
add(
    "key_limits",
    lambda s, d: k(s, d).select(
        "id",
        credentials.limit_of(F.col("rate_limit_overrides"), "per_minute", S.PER_MINUTE).alias("per_minute"),
        credentials.limit_of(F.col("rate_limit_overrides"), "per_day", S.PER_DAY).alias("per_day"),
    ),
    f"""select id, coalesce(cast(json_extract(rate_limit_overrides,'$.per_minute') as int),60) as per_minute,
        coalesce(cast(json_extract(rate_limit_overrides,'$.per_day') as int),10000) as per_day from {K}""", K,
)
add(
    "key_snapshot", lambda s, d: keys.key_snapshot(view(s, d, "key_events")),
    """select c.key_id, c.name, c.is_admin, c.ts as created_at, r.revoked_at, r.revoked_at is null as active
       from (select * from key_events where action='create') c
       left join (select key_id, min(ts) as revoked_at from key_events where action='revoke' group by 1) r using (key_id)""",
    "key_events",
)
add(
    "key_snapshot_as_of", lambda s, d: keys.key_snapshot(view(s, d, "key_events"), "1994-06-01"),
    """select c.key_id, c.name, c.is_admin, c.ts as created_at, r.revoked_at, r.revoked_at is null as active
       from (select * from key_events where action='create' and ts <= timestamp '1994-06-01 00:00:00') c
       left join (select key_id, min(ts) as revoked_at from key_events
                  where action='revoke' and ts <= timestamp '1994-06-01 00:00:00' group by 1) r using (key_id)""",
    "key_events",
)

# metrics -------------------------------------------------------------------------------------
M = "select '{m}' as metric, {l} as labels, round(sum({v}),8) as value from g where {w} group by 1, 2"
METRIC_SQL = "with g as (select u.*, k.key_prefix as pfx from usage_logs u left join api_keys k on k.id=u.api_key_id)\n" + "\nunion all\n".join(
    M.format(m=m, l=l, v=v, w=w)
    for m, l, v, w in [
        ("requests_total", "concat('cache_hit=',cache_hit,',provider=',provider,',status=',status)", "1.0::double", "status in ('success','error')"),
        ("tokens_total", "concat('kind=prompt,provider=',provider)", "prompt_tokens::double", "status='success'"),
        ("tokens_total", "concat('kind=completion,provider=',provider)", "completion_tokens::double", "status='success'"),
        ("cost_usd_total", "concat('api_key_prefix=',coalesce(pfx,''),',provider=',provider)", "cost_usd", "status='success'"),
        ("rate_limit_rejections_total", "concat('api_key_prefix=',coalesce(pfx,''))", "1.0::double", "status='rate_limited'"),
        ("cache_exact_hits_total", "''", "1.0::double", "status<>'rate_limited' and cache_hit='exact'"),
        ("cache_exact_misses_total", "''", "1.0::double", "status<>'rate_limited' and cache_hit<>'exact'"),
        ("cache_semantic_hits_total", "''", "1.0::double", "status<>'rate_limited' and cache_hit='semantic'"),
        ("cache_semantic_misses_total", "''", "1.0::double", "status<>'rate_limited' and cache_hit='none'"),
    ]
)
add("metric_totals", lambda s, d: metrics.metric_totals(u(s, d), k(s, d)), METRIC_SQL, U, K)
BOUNDS = S.DURATION_BUCKETS
add(
    "latency_histogram", lambda s, d: metrics.latency_histogram(u(s, d)),
    "select le, count, sum_seconds from (" + " union all ".join(
        [f"select '{b:g}' as le, count(*) filter (where latency_ms/1000.0::double <= {b}) as count, round(sum(latency_ms/1000.0::double),3) as sum_seconds from {U} where status='success'" for b in BOUNDS]
        + [f"select '+Inf', count(*), round(sum(latency_ms/1000.0::double),3) from {U} where status='success'"]
    ) + ") x", U,
)
ERROR_LOG = """
select event_id as id, case when event_id%2=0 then 'openai' else 'gemini' end as provider,
  case when event_id%10=0 then case when event_id%4=0 then 'InternalServerError' else 'PermissionDeniedError' end
       when event_id%10=5 then case when event_id%4=1 then 'ServiceUnavailable' else 'NotFound' end
       when event_id%14=1 then 'ProviderRateLimitError' when event_id%14=4 then 'ProviderServerError'
       when event_id%3=0 then case when event_id%2=0 then 'RateLimitError' else 'ResourceExhausted' end
       when event_id%3=1 then case when event_id%2=0 then 'BadRequestError' else 'PermissionDenied' end
       when event_type='view' then 'ProviderDisabledError'
       when event_type='click' then 'APIConnectionError' else 'SomethingElse' end as error_name
from {events}
"""
# the rule by itself: what each client raises, by the class that catches it
CLASSES = """('openai','RateLimitError','rate_limit'),('openai','APIConnectionError','timeout'),('openai','BadRequestError','bad_request'),
  ('openai','InternalServerError','server'),('openai','PermissionDeniedError','server'),('gemini','ResourceExhausted','rate_limit'),
  ('gemini','PermissionDenied','auth'),('gemini','ServiceUnavailable','server'),('gemini','NotFound','server'),
  ('openai','ProviderRateLimitError','rate_limit'),('gemini','ProviderRateLimitError','rate_limit'),
  ('openai','ProviderServerError','server'),('gemini','ProviderServerError','server')"""
add(
    "errors_by_provider",
    lambda s, d: metrics.errors_by_provider(s.sql(ERROR_LOG, events=base(s, d, "events"))),
    f"""with e as ({ERROR_LOG.format(events='events')}),
    c(provider, name, cls) as (values {CLASSES}),
    x as (select e.provider, case when error_name='ProviderDisabledError' then 'disabled' else coalesce(cls,'other') end as error_class
          from e left join c on c.provider=e.provider and c.name=e.error_name)
    select provider, error_class, count(*) as errors,
      case when error_class in ('rate_limit','timeout','server') then 'retryable'
           when error_class in ('auth','bad_request','disabled') then 'fatal' else 'next_provider' end as handling
    from x group by 1,2""",
)


def _samples(s, d):
    """Labels as text, as maps have no order to compare by."""
    found = metrics.metric_samples(u(s, d), s.sql(ERROR_LOG, events=base(s, d, "events")))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("metric", F.array_join(F.array_sort(pairs), ",").alias("labels"), "value")


add(
    "metric_samples", _samples,
    f"""with e as ({ERROR_LOG.format(events='events')}),
    c(provider, name, cls) as (values {CLASSES}),
    x as (select e.provider, case when error_name='ProviderDisabledError' then 'disabled' else coalesce(cls,'other') end as error_class
          from e left join c on c.provider=e.provider and c.name=e.error_name),
    g as (select *, case when model='embeddings' then 'embeddings' else 'chat' end as endpoint from {U})
    select 'requests_total' as metric, concat('cache_hit=',cache_hit,',endpoint=',endpoint,',provider=',provider,',status=',status) as labels,
      count(*)::double as value from g group by 1, 2
    union all select 'request_duration_seconds_count', concat('endpoint=',endpoint), (count(*) filter (where status='success' and latency_ms is not null))::double
      from g group by 1, 2
    union all select 'request_duration_seconds_sum', concat('endpoint=',endpoint), round(coalesce(sum(latency_ms) filter (where status='success'), 0)/1000.0::double, 8)
      from g group by 1, 2
    union all select 'provider_errors_total', concat('error_class=',error_class,',provider=',provider), count(*)::double from x group by 1, 2""", U,
)

# quality -------------------------------------------------------------------------------------


def _usage_quality(s, d):
    rules = quality.Rules(**{**quality.USAGE_RULES.__dict__, "foreign": {"api_key_id": k(s, d)}})
    return quality.quality_report(u(s, d), rules)


def _checks_sql(table, rules, foreign=()):
    parts = [f"select 'not_null:{c}' as \"check\", count(*) filter (where {c} is null) as violations from {table}" for c in rules.not_null]
    parts += [f"select 'max_length:{c}', count(*) filter (where length({c})>{n}) from {table}" for c, n in rules.max_length.items()]
    parts += [
        f"select 'domain:{c}', count(*) filter (where {c} not in ({', '.join(repr(x) for x in v)})) from {table}"
        for c, v in rules.domain.items()
    ]
    parts += [f"select 'vector_dim:{c}', count(*) filter (where len({c})<>{n}) from {table}" for c, n in rules.vector_dim.items()]
    parts += [
        f"select 'unique:{c}', count(*) from (select {c} from {table} where {c} is not null group by 1 having count(*)>1) x"
        for c in rules.unique
    ]
    parts += [f"select 'foreign:{c}', count(*) from {table} t where {c} is not null and not exists (select 1 from {p} p where p.id=t.{c})" for c, p in foreign]
    return "\nunion all\n".join(parts)


add("quality_usage", _usage_quality, _checks_sql(U, quality.USAGE_RULES, [("api_key_id", K)]), U, K)
add("quality_keys", lambda s, d: quality.quality_report(k(s, d), quality.KEY_RULES), _checks_sql(K, quality.KEY_RULES), K)
STORED = """
select doc_id as id, md5(cast(doc_id%1000 as string)) as request_hash, case when doc_id%9<>0 then lang end as model, text as messages,
  text as response, cast(n_chars as int) as prompt_tokens, 0 as completion_tokens, timestamp '2024-01-01 00:00:00' as created_at
from {documents}
"""
STORED_ENTRIES = """
select vec_id as id, md5(cast(vec_id%3000 as string)) as request_hash, embedding, cast(label as string) as prompt_text,
  'm' as model, timestamp '2024-01-01 00:00:00' as created_at
from {embeddings}
"""


def _stored(s, d, text, name):
    return s.sql(text, **{name: base(s, d, name)})


def _entry_quality(s, d):
    parents = _stored(s, d, STORED, "documents").select(F.col("request_hash").alias("id"))
    rules = quality.Rules(**{**quality.ENTRY_RULES.__dict__, "foreign": {"request_hash": parents}})
    return quality.quality_report(_stored(s, d, STORED_ENTRIES, "embeddings"), rules)


add("quality_jobs", lambda s, d: quality.quality_report(view(s, d, "jobs"), quality.JOB_RULES), _checks_sql("jobs", quality.JOB_RULES), "jobs")
add(
    "quality_responses", lambda s, d: quality.quality_report(_stored(s, d, STORED, "documents"), quality.RESPONSE_RULES),
    f"with r as ({STORED.format(documents='documents')})\n" + _checks_sql("r", quality.RESPONSE_RULES),
)
add(
    "quality_entries", _entry_quality,
    f"with p as (select request_hash as id from ({STORED.format(documents='documents')}) x), e as ({STORED_ENTRIES.format(embeddings='embeddings')})\n"
    + _checks_sql("e", quality.ENTRY_RULES, [("request_hash", "p")]),
)
add(
    "orphan_entries",
    lambda s, d: keys.orphans(
        _stored(s, d, STORED_ENTRIES, "embeddings"), _stored(s, d, STORED, "documents"), "request_hash", "request_hash"
    ).select("id", "request_hash"),
    f"""with p as ({STORED.format(documents='documents')}), e as ({STORED_ENTRIES.format(embeddings='embeddings')})
    select id, request_hash from e where not exists (select 1 from p where p.request_hash=e.request_hash)""",
)
VECTOR_RULES = quality.Rules(not_null=["vec_id", "embedding"], vector_dim={"embedding": 64}, unique=["vec_id"])
add(
    "quality_vectors", lambda s, d: quality.quality_report(base(s, d, "embeddings"), VECTOR_RULES),
    _checks_sql("embeddings", VECTOR_RULES),
)
