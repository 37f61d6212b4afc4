"""Registered queries over request documents, hashes, attempts and jobs, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import messages as M
from ..functions.times import iso
from ..functions.numbers import backoff_seconds
from ..operators import attempts, filters, inputs, jobs, keys, stores
from ..sources import documents
from ..sources.driver_views import base, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, sql=None, *views):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = with_views(sql, *views) if views else sql


def conversation_messages(spark, d):
    """One message array per conversation, in turn order (the request document's own unit)."""
    turns = base(spark, d, "conversations")
    return turns.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
        ).alias("messages")
    )


def requests(spark, d):
    flat = view(spark, d, "requests_flat")
    return flat.join(conversation_messages(spark, d), "conv_id")


MESSAGES_SQL = """messages as (
  select conv_id, list(struct_pack(content := text, role := role) order by turn) as messages,
    arg_max(text, turn) filter (where role='user') as last_user
  from conversations group by 1)"""
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"

# documents -----------------------------------------------------------------------------------


def _valid(s, d):
    ok, _ = documents.parse_requests(view(s, d, "request_docs"))
    return ok.select(
        "id", "model", F.size("messages").cast("bigint").alias("n_messages"),
        F.try_element_at("messages", F.lit(1))["role"].alias("role"),
        F.try_element_at("messages", F.lit(1))["content"].alias("content"),
        "temperature", "max_tokens",
    )


DOC_SQL = """with j as (select id, body, case when json_valid(body) then cast(body as json) end as doc from request_docs),
p as (select id, body, case when doc is null then 'malformed' when doc->>'$.model' is null then 'model missing'
    when json_type(doc,'$.model')<>'VARCHAR' then 'bad model'
    when len(cast(doc->'$.messages' as json[]))>0 and doc->>'$.messages[0].role' not in ('system','user','assistant') then 'bad role'
    when json_array_length(doc->'$.messages')>0 and doc->>'$.messages[0].content' is null then 'content missing'
    when json_type(doc,'$.messages[0].content')<>'VARCHAR' then 'bad content'
    when cast(doc->>'$.max_tokens' as double) <> floor(cast(doc->>'$.max_tokens' as double)) then 'bad number' end as problem,
    doc from j)
"""
add(
    "parse_requests", _valid,
    DOC_SQL + """select id, doc->>'$.model' as model, json_array_length(doc->'$.messages')::bigint as n_messages,
    doc->>'$.messages[0].role' as role, doc->>'$.messages[0].content' as content,
    cast(doc->>'$.temperature' as double) as temperature, cast(cast(doc->>'$.max_tokens' as double) as int) as max_tokens
    from p where problem is null""", "request_docs",
)
add(
    "quarantined_requests", lambda s, d: documents.parse_requests(view(s, d, "request_docs"))[1],
    DOC_SQL + "select id, body, problem from p where problem is not null", "request_docs",
)
add(
    "flatten_choices",
    lambda s, d: documents.flatten_choices(documents.parse_responses(view(s, d, "response_docs"))),
    """select id, doc->>'$.id' as response_id, 'chat.completion' as object, doc->>'$.model' as response_model,
      doc->>'$.provider' as response_provider, cache_hit as x_cache_hit,
      coalesce(cast(c->>'$.index' as int),0) as choice_index, c->>'$.message.role' as role,
      c->>'$.message.content' as content, c->>'$.finish_reason' as finish_reason,
      coalesce(cast(doc->>'$.usage.prompt_tokens' as int),0) as prompt_tokens,
      coalesce(cast(doc->>'$.usage.completion_tokens' as int),0) as completion_tokens,
      coalesce(cast(doc->>'$.usage.total_tokens' as int),0) as total_tokens
    from (select id, cache_hit, cast(body as json) as doc, unnest(cast(cast(body as json)->'$.choices' as json[])) as c
          from response_docs) x""", "response_docs",
)

BAD_RESPONSES = """
select event_id as id, case
    when event_id%5=0 then '{{"id":"r","model":"m1","provider":"gemini"}}'
    when event_id%5=1 then '{{"id":7,"model":"m1","provider":"gemini","choices":[]}}'
    when event_id%5=2 then '{{"id":"r","model":"m1","provider":"gemini","choices":[{{"message":{{"role":"assistant","content":null}}}}]}}'
    when event_id%5=3 and event_id%2=0 then '[1]'
    when event_id%5=3 then '{{"id":"r","model":"m1","provider":"gemini","choices":[],"usage":{{"total_tokens":1.5}}}}'
    else '{{"id":"r","model":"m1","provider":"gemini","choices":[{{"message":{{"role":"assistant","content":"x"}}}}]}}' end as body
from {events}
"""
add(
    "rejected_responses", lambda s, d: documents.rejected_responses(s.sql(BAD_RESPONSES, events=base(s, d, "events"))),
    f"""with r as ({BAD_RESPONSES.format(events='events')}), j as (select id, body, cast(body as json) as doc from r)
    select * from (select id, body, case when json_type(doc)<>'OBJECT' then 'malformed'
      when json_type(doc,'$.id')<>'VARCHAR' then 'bad field' when json_type(doc,'$.choices') is null then 'choices missing'
      when json_array_length(doc->'$.choices')>0 and doc->>'$.choices[0].message.content' is null then 'bad message'
      when json_type(doc,'$.usage.total_tokens')='DOUBLE' then 'bad number' end as problem from j) x where problem is not null""",
)
add(
    "requests_coverage",
    lambda s, d: view(s, d, "requests_flat").select("conv_id", F.lit("used").alias("side"))
    .union(base(s, d, "conversations").select("conv_id", F.lit("given"))).distinct()
    .agg(F.count_if(F.col("side") == "used").alias("used"), F.count_if(F.col("side") == "given").alias("given")),
    "select (select count(distinct conv_id) from requests_flat) as used, (select count(distinct conv_id) from conversations) as given",
    "requests_flat",
)

# message functions ---------------------------------------------------------------------------


def _hashes(s, d):
    """The hash of every request. Equal documents are hashed once, so no request row carries its messages."""
    flat = view(s, d, "requests_flat")
    null_int, null_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    docs = flat.select("conv_id", "model", "temperature").distinct().join(conversation_messages(s, d), "conv_id")
    hashed = docs.select(
        F.col("conv_id").alias("c"), F.col("model").alias("m"), F.col("temperature").alias("t"),
        M.request_hash(F.col("model"), F.col("messages"), F.col("temperature"), null_double, null_int).alias("request_hash"),
    )
    same = (F.col("conv_id") == F.col("c")) & (F.col("model") == F.col("m")) & F.col("temperature").eqNullSafe(F.col("t"))
    return flat.join(hashed, same).select("id", "request_hash")


add(
    "request_hash", _hashes,
    f"""with {MESSAGES_SQL}
    select r.id, sha256(cast(to_json({{'max_tokens': cast(null as int), 'messages': m.messages, 'model': r.model,
      'temperature': r.temperature, 'top_p': cast(null as double)}}) as varchar)) as request_hash
    from requests_flat r join messages m using (conv_id)""", "requests_flat",
)


def _hash_classes(s, d):
    """Do both hashes put the same requests together? Equal documents are hashed once."""
    same = view(s, d, "requests_flat").groupBy("conv_id", "model", "temperature").agg(F.count("*").alias("n"))
    r = same.join(conversation_messages(s, d), "conv_id")
    null_int, null_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    args = (F.col("model"), F.col("messages"), F.col("temperature"), null_double, null_int)
    both = r.select(M.request_hash(*args).alias("a"), M.request_hash_py(*args).alias("b"), "n")
    pairs = both.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_distinct("a").alias("hashes"), F.count_distinct("b").alias("python_hashes"),
        F.sum("n").alias("requests"),
    )


add(
    "request_hash_classes", _hash_classes,
    """with x as (select r.conv_id, r.model, r.temperature, count(*) as n from requests_flat r group by 1,2,3)
    select count(*) as pairs, count(*) as hashes, count(*) as python_hashes, cast(sum(n) as bigint) as requests from x""",
    "requests_flat",
)
add(
    "last_user_message",
    lambda s, d: requests(s, d).select("id", M.last_user_message(F.col("messages")).alias("last_user")),
    f"with {MESSAGES_SQL} select r.id, m.last_user from requests_flat r join messages m using (conv_id)", "requests_flat",
)
add(
    "reshape_messages",
    lambda s, d: conversation_messages(s, d).select(
        "conv_id",
        M.system_instruction(F.col("messages")).alias("system_instruction"),
        F.inline_outer(M.contents(F.col("messages"))),
    ).select("conv_id", "system_instruction", "role", F.col("parts")[0].alias("part")),
    """select c.conv_id, s.txt as system_instruction, case when role='user' then 'user' else 'model' end as role, text as part
    from conversations c left join (select conv_id, string_agg(text, chr(10) order by turn) as txt from conversations
      where role='system' group by 1) s using (conv_id)
    where role<>'system'
    union all
    select conv_id, string_agg(text, chr(10) order by turn), null, null from conversations
    group by 1 having count(*) filter (where role<>'system')=0""",
)
add(
    "fallback_order",
    lambda s, d: base(s, d, "documents").select("doc_id", F.concat_ws(", ", "lang", "source", F.lit(" "), F.lit("gemini")).alias("csv"))
    .select("doc_id", F.posexplode(M.parse_order(F.col("csv"))).alias("rank", "name")),
    """select doc_id, cast(r-1 as int) as rank, name from (
      select doc_id, unnest(names) as name, generate_subscripts(names, 1) as r from (
        select doc_id, list_filter(list_transform(string_split(concat(lang, ', ', source, ',  , ', 'gemini'), ','), lambda x: trim(x)),
          lambda x: x<>'') as names from documents) a) b""",
)

# inputs --------------------------------------------------------------------------------------
INPUT_DOCS = """
select event_id as id, case
    when event_id%7=0 then '"one text"'
    when event_id%7=1 then '[]'
    when event_id%7=2 then '42'
    when event_id%11=0 then concat('["a",', case event_id%3 when 0 then '5' when 1 then 'null' else '{{"x":1}}' end, ']')
    when event_id%7=3 then concat('["', repeat('x","', cast(regexp_extract(props,'([0-9]+)',1) as int)+50), 'last"]')
    else concat('["', event_type, '","', regexp_extract(props,'([0-9]+)',1), '"]') end as input
from {events}
"""


def _input_docs(s, d):
    return s.sql(INPUT_DOCS, events=base(s, d, "events"))


INPUT_SQL = f"""with d as ({INPUT_DOCS.format(events='events')}),
t as (select id, case when starts_with(input,'["a",') then null when starts_with(input,'[') then cast(cast(input as json) as varchar[])
             when starts_with(input,'"') then [cast(input as json)->>'$'] end as texts from d),
p as (select *, case when texts is null then 'malformed' when len(texts)=0 then 'input empty'
             when len(texts)>100 then 'too many inputs' end as problem from t)
"""
add(
    "explode_inputs", lambda s, d: inputs.explode_inputs(_input_docs(s, d))[0],
    INPUT_SQL + """select id, cast(pos-1 as int) as pos, text, cast(floor((pos-1)/32) as int) as chunk from (
    select id, unnest(texts) as text, generate_subscripts(texts,1) as pos from p where problem is null) x""",
)
add(
    "rejected_inputs", lambda s, d: inputs.explode_inputs(_input_docs(s, d))[1],
    INPUT_SQL + "select id, problem from p where problem is not null",
)

# attempts ------------------------------------------------------------------------------------
add(
    "resolve_attempts", lambda s, d: attempts.resolve_attempts(view(s, d, "attempts")),
    """with st as (select request_id, min(attempt_no) filter (where outcome in ('ok','auth','bad_request','disabled')) as stop
      from attempts group by 1),
    u as (select a.* from attempts a join st using (request_id) where stop is null or attempt_no<=stop),
    pp as (select request_id, provider_ord, count(*) as tries from u group by 1,2),
    b as (select request_id, count(*)-1 as fallbacks, cast(sum(tries) as bigint) as attempts,
      round(sum(coalesce((select sum(least(pow(2,w-1),8)) from range(1, tries) t(w)),0)),6) as backoff_seconds from pp group by 1),
    l as (select request_id, arg_max(outcome, attempt_no) as o, arg_max(provider, attempt_no) as provider from u group by 1)
    select l.request_id, case when o='ok' then 'ok' else 'error' end as outcome, provider,
      case when o<>'ok' then o end as last_error, attempts, fallbacks, backoff_seconds from l join b using (request_id)""",
    "attempts",
)
add(
    "backoff_waits",
    lambda s, d: view(s, d, "attempts").groupBy("request_id").agg(
        F.round(F.sum(backoff_seconds(F.col("attempt_no"), 0.5)), 6).alias("waits")
    ),
    "select request_id, round(sum(least(greatest(0.5::double*pow(2,attempt_no-1),0.5),4.0)),6) as waits from attempts group by 1",
    "attempts",
)

# jobs ----------------------------------------------------------------------------------------
SECONDS = "cast(floor((epoch_us({b})//1000-epoch_us({a})//1000)/1000) as bigint)"
add(
    "job_lifecycle",
    lambda s, d: jobs.job_lifecycle(view(s, d, "job_events"), "1998-12-31", 3600),
    f"""with e as (select * from job_events where ts <= timestamp '1998-12-31 00:00:00'),
    p as (select job_id, arg_max(status, (ts, case status when 'pending' then 0 when 'running' then 1 else 2 end)) as status,
      min(ts) filter (where status='pending') as created_at, min(ts) filter (where status='running') as started_at,
      max(ts) filter (where status in ('succeeded','failed')) as finished_at from e group by 1)
    select *, {SECONDS.format(a='created_at', b='started_at')} as queue_seconds,
      {SECONDS.format(a='started_at', b='finished_at')} as run_seconds,
      status='running' and {SECONDS.format(a='started_at', b="timestamp '1998-12-31 00:00:00'")} > 3600 as stuck from p""",
    "job_events",
)
add(
    "job_summary", lambda s, d: jobs.job_summary(view(s, d, "jobs")),
    f"""select status, count(*) as jobs,
      cast(floor(round(avg({SECONDS.format(a='created_at', b='started_at')}),6)) as bigint) as avg_queue_seconds,
      cast(floor(round(avg({SECONDS.format(a='started_at', b='finished_at')}),6)) as bigint) as avg_run_seconds
    from jobs group by 1""", "jobs",
)
add(
    "job_verdicts", lambda s, d: jobs.check_transitions(view(s, d, "job_events")),
    """with f as (select job_id, min(ts) filter (where status='pending') as p, min(ts) filter (where status='running') as r,
      min(ts) filter (where status in ('succeeded','failed')) as f, count(*) filter (where status='succeeded') as a,
      count(*) filter (where status='failed') as b from job_events group by 1)
    select case when p is null then 'never created' when f is not null and r is null then 'finished without running'
      when r<p then 'ran before creation' when f<r then 'finished before running'
      when a>0 and b>0 then 'both succeeded and failed' else 'valid' end as verdict, count(*) as jobs from f group by 1""",
    "job_events",
)
DETAIL = "cast(id as varchar) as id, kind, status, input, {r} as result, error, " + ", ".join(
    f"{ISO.format(c=c)} as {c}" for c in ("created_at", "started_at", "finished_at")
)
add("job_detail", lambda s, d: filters.job_detail(view(s, d, "jobs")), f"select {DETAIL.format(r='result')} from jobs", "jobs")
add(
    "job_detail_light", lambda s, d: filters.job_detail(view(s, d, "jobs"), include_result=False),
    f"select {DETAIL.format(r='cast(null as varchar)')} from jobs", "jobs",
)


def _access(s, d):
    asked = base(s, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("api_key_id"), F.col("l_linenumber").alias("line")
    )
    return filters.job_access(asked, view(s, d, "jobs"), view(s, d, "api_keys"))


add(
    "job_access", _access,
    """select l_orderkey as job_id, l_suppkey as api_key_id, l_linenumber as line,
      case when j.id is null then 'not_found' when j.api_key_id=l_suppkey or coalesce(k.is_admin,false) then 'ok'
           else 'forbidden' end as decision
    from lineitem l left join jobs j on j.id=l_orderkey left join api_keys k on k.id=l_suppkey""", "jobs", "api_keys",
)
add(
    "orphan_jobs",
    lambda s, d: keys.orphans(
        view(s, d, "jobs"), filters.active_keys(view(s, d, "api_keys")), "api_key_id"
    ).select("id", "api_key_id"),
    """select id, api_key_id from jobs j where not exists
       (select 1 from api_keys k where k.id=j.api_key_id and k.revoked_at is null)""", "jobs", "api_keys",
)

# stores --------------------------------------------------------------------------------------
RESPONSE_ROWS = """
select event_id as id, md5(cast(cast(regexp_extract(props,'([0-9]+)',1) as int)*3+user_id%3 as string)) as request_hash,
  'm1' as model, user_id as prompt_tokens, ts as created_at
from {events}
"""
OLD_ROWS = """
select distinct md5(cast(c_custkey*2 as string)) as request_hash, 'm0' as model,
  cast(c_custkey as bigint) as prompt_tokens, timestamp '2023-01-01 00:00:00' as created_at
from {customer}
"""


def _upsert(s, d):
    incoming = s.sql(RESPONSE_ROWS, events=base(s, d, "events"))
    old = s.sql(OLD_ROWS, customer=base(s, d, "customer")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return stores.upsert_responses(old, incoming, order=["created_at", "id"]).select(
        "request_hash", "model", "prompt_tokens", "created_at"
    )


add(
    "upsert_responses", _upsert,
    f"""with inc as ({RESPONSE_ROWS.format(events='events')}), old as ({OLD_ROWS.format(customer='customer')})
    select * from old union all
    select request_hash, model, prompt_tokens, created_at from (
      select *, row_number() over (partition by request_hash order by created_at, id) as rn from inc) x
    where rn=1 and not exists (select 1 from old o where o.request_hash=x.request_hash)""",
)
