"""Fixed schemas of the five tables and the request/response documents."""

from pyspark.sql import types as T

NTZ = T.TimestampNTZType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


L, I, D, STR, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()

USAGE = _struct(
    ("id", L), ("request_id", STR), ("api_key_id", L), ("model", STR), ("provider", STR),
    ("prompt_tokens", I), ("completion_tokens", I), ("total_tokens", I), ("cost_usd", D),
    ("latency_ms", I), ("cache_hit", STR), ("status", STR), ("error", STR), ("created_at", NTZ),
)
KEYS = _struct(
    ("id", L), ("name", STR), ("key_prefix", STR), ("user_email", STR), ("is_admin", B),
    ("rate_limit_overrides", STR), ("created_at", NTZ), ("revoked_at", NTZ),
)
MESSAGE = _struct(("role", STR), ("content", STR))
MESSAGES = T.ArrayType(MESSAGE)
REQUEST_DOC = _struct(
    ("model", STR), ("messages", MESSAGES), ("temperature", D), ("max_tokens", I), ("top_p", D), ("user", STR),
)
TOKENS = _struct(("prompt_tokens", I), ("completion_tokens", I), ("total_tokens", I))
CHOICE = _struct(("index", I), ("message", MESSAGE), ("finish_reason", STR))
RESPONSE_DOC = _struct(
    ("id", STR), ("model", STR), ("provider", STR), ("choices", T.ArrayType(CHOICE)), ("usage", TOKENS),
)
RESPONSES = _struct(
    ("request_hash", STR), ("model", STR), ("messages", MESSAGES), ("response", RESPONSE_DOC),
    ("prompt_tokens", I), ("completion_tokens", I), ("created_at", NTZ), ("expires_at", NTZ),
)
ENTRIES = _struct(
    ("id", L), ("request_hash", STR), ("embedding", T.ArrayType(T.FloatType())), ("prompt_text", STR),
    ("model", STR), ("created_at", NTZ),
)
JOBS = _struct(
    ("id", L), ("api_key_id", L), ("kind", STR), ("status", STR), ("input", STR), ("result", STR),
    ("error", STR), ("created_at", NTZ), ("started_at", NTZ), ("finished_at", NTZ),
)
