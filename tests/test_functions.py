import hashlib
import json

from pyspark.sql import functions as F

from trafficlens import settings as S
from trafficlens.functions import credentials as C, display, errors, messages as M, numbers as N, times as T, vectors as V
from trafficlens.operators.accounting import with_cost
from trafficlens.sources.schemas import MESSAGES
from trafficlens.sources.tables import pricing_df

REQ = "model string, messages array<struct<role:string,content:string>>, temperature double, top_p double, max_tokens int"


def hashes(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + REQ)
    args = [F.col(c) for c in ("model", "messages", "temperature", "top_p", "max_tokens")]
    out = df.select("i", M.request_hash(*args).alias("a"), M.request_hash_py(*args).alias("b")).orderBy("i").collect()
    return [(r.a, r.b) for r in out]


def test_request_hash_is_stable_and_sensitive(spark):
    base = ("m", [("user", "hi")], 0.5, None, 10)
    variants = [
        base, base, ("m", [("user", "ho")], 0.5, None, 10), ("n", [("user", "hi")], 0.5, None, 10),
        ("m", [("user", "hi")], 0.6, None, 10), ("m", [("user", "hi")], 0.5, None, 11), ("m", [("user", "hi")], 0.5, 0.5, 10),
    ]
    out = hashes(spark, *variants)
    for kind in (0, 1):
        h = [x[kind] for x in out]
        assert h[0] == h[1] and len(h[0]) == 64
        assert len(set(h)) == len(variants) - 1


def test_python_hash_bytes(spark):
    row = ("m", [("user", "né\n\"ü\""), ("assistant", "日本")], 1.0, 0.5, None)
    doc = {
        "model": "m", "messages": [{"role": r, "content": c} for r, c in row[1]],
        "temperature": 1.0, "top_p": 0.5, "max_tokens": None,
    }
    want = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert hashes(spark, row)[0][1] == want


def one(spark, col, **cols):
    df = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]) if cols else spark.range(1)
    return df.select(col.alias("x")).head().x


def msgs(*pairs):
    if not pairs:
        return F.from_json(F.lit("[]"), MESSAGES)
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in pairs])


def test_last_user_turn(spark):
    assert one(spark, M.last_user_message(msgs(("user", "one"), ("assistant", "ok"), ("user", "two")))) == "two"
    assert one(spark, M.last_user_message(msgs(("system", "s"), ("assistant", "ok")))) is None
    assert one(spark, M.last_user_message(msgs())) is None


def test_reshape(spark):
    m = msgs(("system", "a"), ("user", "q"), ("system", "b"), ("assistant", "r"))
    assert one(spark, M.system_instruction(m)) == "a\nb"
    assert one(spark, M.system_instruction(msgs(("user", "q")))) is None
    assert [(c.role, c.parts) for c in one(spark, M.contents(m))] == [("user", ["q"]), ("model", ["r"])]


def test_prices(spark):
    rows = [("openai", "gpt-4o-mini", 1000, 1000), ("openai", "unknown", 1000, 1000), ("gemini", "gemini-1.5-pro", 0, 0)]
    df = spark.createDataFrame(rows, "provider string, model string, prompt_tokens int, completion_tokens int")
    got = {r.model: r.cost_usd for r in with_cost(df, pricing_df(spark)).collect()}
    assert abs(got["gpt-4o-mini"] - (0.00015 + 0.0006)) < 1e-12
    assert got["unknown"] == 0.0 and got["gemini-1.5-pro"] == 0.0


def test_charged(spark):
    df = spark.createDataFrame([("none", 5), ("exact", 5), ("semantic", 5)], "h string, t int")
    assert [r.x for r in df.select(N.charged(F.col("h"), F.col("t")).alias("x")).collect()] == [5, 0, 0]


def test_credentials(spark):
    tag = S.KEY_TAG
    assert one(spark, C.key_prefix(F.lit("foreign-abc"))) is None
    assert one(spark, C.key_prefix(F.lit(""))) is None
    assert one(spark, C.key_prefix(F.lit(tag + "abcdefghij"))) == tag + "abcdef"
    for header, token, state in [
        ("Bearer  x ", "x", "token"), ("Bearer \t x\u00a0\n", "x", "token"), ("bearer abc", "abc", "token"), ("Basic abc", None, "invalid_scheme"),
        ("Bearer", None, "invalid_scheme"), ("", None, "missing"),
    ]:
        assert one(spark, C.bearer_token(F.lit(header))) == token
        assert one(spark, C.bearer_state(F.lit(header))) == state
    assert one(spark, C.bearer_state(F.lit(None).cast("string"))) == "missing"


def test_limits_from_overrides(spark):
    get = lambda o: one(spark, C.limit_of(F.lit(o).cast("string"), "per_minute", 60))
    assert [get(o) for o in (None, "{}", '{"per_day":3}', '{"per_minute":0}', '{"per_minute":7}')] == [60, 60, 60, 0, 7]
    odd = ['{"per_minute":2.5}', '{"per_minute":true}', '{"per_minute":"x"}', '{"per_minute":-0.5}', '{"per_minute":null}', "broken"]
    assert [get(o) for o in odd] == [2, 1, 60, 0, 60, 60]
    problem = lambda o: one(spark, C.limit_problem(F.lit(o), "per_minute"))
    assert [problem(o) for o in odd] == [None, None, "x", None, None, None]


def test_backoff(spark):
    waits = [one(spark, N.backoff_seconds(F.lit(n), 1)) for n in range(1, 7)]
    assert waits == [1.0, 2.0, 4.0, 8.0, 8.0, 8.0]
    from trafficlens.operators.attempts import total_backoff

    for n in range(7):
        assert one(spark, total_backoff(F.lit(n), 1)) == sum(waits[:n])


def test_error_classes(spark):
    cls = lambda p, n: one(spark, errors.classify_error(F.lit(p), F.lit(n)))
    assert cls("openai", "RateLimitError") == "rate_limit"
    assert cls("gemini", "DeadlineExceeded") == "timeout"
    assert cls("gemini", "RateLimitError") == "other"
    assert cls("openai", "InternalServerError") == "server"
    assert cls("gemini", "ServiceUnavailable") == "server"
    assert cls("anything", "ProviderBadRequestError") == "bad_request"
    assert cls("anthropic", "ProviderDisabledError") == "disabled"
    how = lambda c: one(spark, errors.error_handling(F.lit(c)))
    assert [how(c) for c in ("timeout", "auth", "other")] == ["retryable", "fatal", "next_provider"]


def test_times_and_numbers(spark):
    ts = F.lit("2024-03-10 12:34:56.789012").cast("timestamp_ntz")
    assert str(one(spark, T.bucket(ts, "hour"))) == "2024-03-10 12:00:00"
    assert one(spark, T.iso(ts)) == "2024-03-10T12:34:56.789012"
    assert one(spark, T.millis(ts)) == 1710074096789
    assert str(one(spark, T.expires_at(ts, 3600))) == "2024-03-10 13:34:56.789012"
    assert one(spark, T.is_live(F.lit(3600_000), F.lit(0), 3600)) is False
    assert one(spark, T.is_live(F.lit(3599_999), F.lit(0), 3600)) is True
    assert one(spark, N.trunc_int(F.lit(1152.9999999999995))) == 1153
    assert one(spark, N.ratio(F.lit(1), F.lit(0))) == 0.0
    assert [one(spark, N.chunk_no(F.lit(p), 32)) for p in (0, 31, 32)] == [0, 0, 1]


def test_display(spark):
    assert one(spark, display.fmt_usd(F.lit(1234.5))) == "$1234.5000"
    assert one(spark, display.fmt_pct(F.lit(0.654))) == "65.4%"
    assert one(spark, display.dash(F.lit(None).cast("string"))) == "—"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(spark, V.cosine_distance(a, b)) - (1 - 2**-0.5)) < 1e-12
    zero, long = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert one(spark, V.cosine_distance(a, zero)) is None
    assert one(spark, V.cosine_distance(a, long)) is None
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_parse_order(spark):
    assert one(spark, M.parse_order(F.lit(" openai, ,gemini ,"))) == ["openai", "gemini"]
