"""The service's tables derived from the given test tables, one SQL text per view.

The text serves both engines: ``{events}`` and so on are DataFrames for ``spark.sql`` and plain
table names for an ANSI-SQL engine. Every view covers all rows of the tables it reads.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

PRICING = """
select * from (values
  ('openai','gpt-4o-mini',cast(0.00015 as double),cast(0.0006 as double)),
  ('gemini','gemini-2.0-flash',cast(0.0001 as double),cast(0.0004 as double))
) t(provider,model,prompt_per_1k,completion_per_1k)
"""

USAGE_LOGS = """
select b.id, md5(cast(b.id as string)) as request_id, b.api_key_id, b.model, b.provider,
  b.prompt_tokens, b.completion_tokens, b.prompt_tokens+b.completion_tokens as total_tokens,
  coalesce(cast(b.prompt_tokens as double)/1000*p.prompt_per_1k
         + cast(b.completion_tokens as double)/1000*p.completion_per_1k, cast(0 as double)) as cost_usd,
  b.latency_ms, b.cache_hit, b.status, b.error, b.created_at
from (
  select id, api_key_id,
    case when id%3=0 then 'gpt-4o-mini' when k%2=0 then 'gemini-2.0-flash' else 'gemini-2.5-flash' end as model,
    case when status='rate_limited' then 'ratelimit' when id%3=0 then 'openai' else 'gemini' end as provider,
    case when status='success' and cache_hit='none' then k*7+1 else 0 end as prompt_tokens,
    case when status='success' and cache_hit='none' then (k*13)%400 else 0 end as completion_tokens,
    latency_ms, cache_hit, status,
    case when status='error' then 'upstream failure'
         when status='rate_limited' then 'rate limit exceeded: 60/minute' end as error,
    created_at
  from (
    select id, api_key_id, k, latency_ms, created_at, status,
      case when status<>'success' then 'none' when event_type='view' then 'exact'
           when event_type='click' and k>=50 then 'semantic' else 'none' end as cache_hit
    from (
      select event_id as id, user_id as api_key_id, event_type,
        cast(regexp_extract(props,'([0-9]+)',1) as int) as k,
        cast(floor(value*10) as int) as latency_ms, ts as created_at,
        case when event_type='error' then 'error'
             when cast(regexp_extract(props,'([0-9]+)',1) as int)<5 then 'rate_limited'
             else 'success' end as status
      from {events}) x) y) b
left join (""" + PRICING + """) p on b.provider=p.provider and b.model=p.model
"""

API_KEYS = """
select c_custkey as id, c_name as name,
  concat('key-',lpad(cast(c_custkey as string),6,'0')) as key_prefix,
  case when c_custkey%3=0 then null else concat('u',cast(c_custkey as string),'@example.com') end as user_email,
  c_mktsegment='BUILDING' as is_admin,
  case when c_custkey%7=0 then '{{"per_minute":0,"per_day":3}}'
       when c_custkey%11=0 then '{{"per_minute":2}}' end as rate_limit_overrides,
  timestamp '2023-12-01 00:00:00' + c_custkey * interval '1' minute as created_at,
  case when c_custkey%10=0 then timestamp '2024-01-20 00:00:00' end as revoked_at
from {customer}
"""

REQUESTS_FLAT = """
select e.event_id as id, e.ts, e.user_id as api_key_id, e.event_type,
  cast(regexp_extract(e.props,'([0-9]+)',1) as int) as k,
  (e.event_id + cast(regexp_extract(e.props,'([0-9]+)',1) as int))
    % (select count(distinct conv_id) from {conversations}) as conv_id,
  case when e.event_id%2=0 then 'gemini-2.0-flash' else 'gpt-4o-mini' end as model,
  case when e.event_id%5=0 then cast(0.5 as double) end as temperature,
  e.event_type<>'error' as fillable
from {events} e
"""

JOBS = """
select o_orderkey as id, o_custkey as api_key_id, 'batch_embeddings' as kind,
  case when o_orderstatus='O' then 'running' when o_orderstatus='P' then 'pending'
       when o_orderkey%5=0 then 'failed' else 'succeeded' end as status,
  concat('{{"provider":"',case when o_orderkey%2=0 then 'openai' else 'gemini' end,'"}}') as input,
  case when o_orderstatus='F' and o_orderkey%5<>0
       then concat('{{"count":',cast(o_custkey as string),'}}') end as result,
  case when o_orderstatus='F' and o_orderkey%5=0 then 'upstream failure' end as error,
  o_orderdate as created_at,
  case when o_orderstatus<>'P' then o_orderdate + (o_orderkey%600) * interval '1' second end as started_at,
  case when o_orderstatus='F' then o_orderdate + (o_orderkey%600+o_orderkey%97) * interval '1' second end as finished_at
from {orders}
"""

JOB_EVENTS = """
select o_orderkey as job_id, 'pending' as status, o_orderdate as ts from {orders}
union all
select o_orderkey, 'running', o_orderdate + (o_orderkey%600) * interval '1' second
from {orders} where o_orderstatus<>'P'
union all
select o_orderkey, case when o_orderkey%5=0 then 'failed' else 'succeeded' end,
  o_orderdate + (o_orderkey%600+o_orderkey%97) * interval '1' second
from {orders} where o_orderstatus='F'
"""

ATTEMPTS = """
select request_id, attempt_no, cast(floor((attempt_no-1)/3) as int) as provider_ord,
  case when attempt_no<=3 then 'openai' when attempt_no<=6 then 'gemini' else 'anthropic' end as provider,
  outcome, ts
from (
  select l_orderkey as request_id,
    cast(row_number() over (partition by l_orderkey
      order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) as int) as attempt_no,
    case when l_returnflag='R' then 'server' when l_linestatus='F' and l_returnflag='A' then 'auth'
         when l_returnflag='A' then 'rate_limit' else 'ok' end as outcome,
    l_shipdate as ts
  from {lineitem}) x
"""

KEY_EVENTS = """
select c_custkey as key_id, 'create' as action, c_name as name, c_mktsegment='BUILDING' as is_admin,
  timestamp '1991-01-01 00:00:00' + c_custkey * interval '1' minute as ts
from {customer}
union all
select o_custkey, 'revoke', cast(null as string), cast(null as boolean), o_orderdate
from {orders} where o_orderstatus='F'
"""

REQUEST_DOCS = """
select event_id as id,
  case when event_id%17=0 then '{{"model": broken'
       when event_id%23=0 then '{{"model":"m1","messages":[{{"role":"user","content":["part",{{"type":"text"}}]}}]}}'
       when event_id%29=0 then '{{"model":5,"messages":[{{"role":"user","content":"x"}}]}}'
       when event_id%31=0 then '{{"model":"m2","messages":[{{"role":"user","content":"x"}}],"temperature":"0.25","max_tokens":5.0}}'
       when event_id%37=0 then '{{"model":"m2","messages":[{{"role":"user","content":12}}]}}'
       when event_id%41=0 then '{{"model":"m2","messages":[{{"role":"user","content":null}}]}}'
       when event_id%43=0 then '{{"model":"m2","messages":[{{"role":"user","content":"x"}}],"max_tokens":5.5}}'
       else concat('{{', case when event_id%13=0 then '' else '"model":"m1",' end,
         case when event_id%19=0 then '"messages":[]'
              else concat('"messages":[{{"role":"',
                case event_type when 'view' then 'user' when 'click' then 'assistant'
                     when 'signup' then 'system' when 'purchase' then 'user' else 'tool' end,
                '","content":"turn ', regexp_extract(props,'([0-9]+)',1), '"}}]') end,
         case when event_id%2=0 then ',"temperature":0.5' else '' end,
         case when event_id%3=0 then concat(',"max_tokens":', regexp_extract(props,'([0-9]+)',1)) else '' end,
         '}}') end as body
from {events}
"""

RESPONSE_DOCS = """
select event_id as id,
  case event_type when 'view' then 'exact' when 'click' then 'semantic' else 'none' end as cache_hit,
  concat('{{"id":"r', cast(event_id as string), '","model":"m1","provider":"gemini","choices":[',
    '{{"index":0,"message":{{"role":"assistant","content":"first ', regexp_extract(props,'([0-9]+)',1),
    '"}},"finish_reason":"stop"}}',
    case when event_id%4=0 then ',{{"index":1,"message":{{"role":"assistant","content":"second"}}}}' else '' end, ']',
    case when event_id%3=0 then concat(',"usage":{{"prompt_tokens":', regexp_extract(props,'([0-9]+)',1),
         ',"completion_tokens":2,"total_tokens":', cast(cast(regexp_extract(props,'([0-9]+)',1) as int)+2 as string), '}}')
         else '' end, '}}') as body
from {events}
"""

PROMPT_VECTORS = """
select vec_id as id, cast(label as string) as model, cast(vec_id as string) as prompt,
  embedding as vec, vec_id%9<>4 as fillable,
  timestamp '2024-01-01 00:00:00' + vec_id * interval '1' minute as ts
from {embeddings}
"""

EMBEDDING_INPUTS = """
select cast(doc_id%10 as bigint) as job_id, cast(floor(doc_id/10) as int) as pos, text
from {documents}
"""

VIEWS = {
    "pricing": PRICING,
    "usage_logs": USAGE_LOGS,
    "api_keys": API_KEYS,
    "requests_flat": REQUESTS_FLAT,
    "jobs": JOBS,
    "job_events": JOB_EVENTS,
    "attempts": ATTEMPTS,
    "key_events": KEY_EVENTS,
    "request_docs": REQUEST_DOCS,
    "response_docs": RESPONSE_DOCS,
    "prompt_vectors": PROMPT_VECTORS,
    "embedding_inputs": EMBEDDING_INPUTS,
}


def tables_of(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; timestamps come out as TIMESTAMP_NTZ."""
    text = VIEWS[name]
    df = spark.sql(text, **{t: base(spark, sf_dir, t) for t in tables_of(text)})
    zoned = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: df[n].cast("timestamp_ntz") for n in zoned}) if zoned else df


def view_sql(name: str) -> str:
    text = VIEWS[name]
    return text.format(**{t: t for t in tables_of(text)})


def with_views(query: str, *names: str) -> str:
    """``query`` preceded by the named views as common table expressions."""
    ctes = ",\n".join(f"{n} as ({view_sql(n)})" for n in names)
    head, body = f"with {ctes}", query.strip()
    lower = body.lower()
    if lower.startswith("with recursive"):
        return head.replace("with ", "with recursive ", 1) + ",\n" + body[len("with recursive"):]
    if lower.startswith("with"):
        return head + ",\n" + body[len("with"):]
    return head + "\n" + body
