"""Parsing and checking of request and response documents given as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from . import schemas

def parsed_once(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the JSON of ``text`` as a VARIANT, null for malformed text.

    It is made by a generator, so no later filter or projection makes Spark parse a row again.
    """
    return df.select("*", F.explode(F.array(F.try_parse_json(F.col(text)))).alias(out))


def _type(v: Column, path: str = "$") -> Column:
    """Type name of a value inside a VARIANT (STRING, BIGINT, ARRAY<...>), VOID for null, null if absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _absent(v: Column, path: str) -> Column:
    return F.coalesce(_type(v, path), F.lit("VOID")) == "VOID"


def _number(v: Column, path: str) -> Column:
    """A number, a numeric text or true/false as double, as a lenient validator reads it."""
    raw = F.try_variant_get(v, path, "string")
    flag = F.when(raw == "true", 1.0).when(raw == "false", 0.0)
    return F.when(_type(v, path) == "BOOLEAN", flag).otherwise(F.trim(raw).try_cast("double"))


def _whole(v: Column, path: str) -> Column:
    number = _number(v, path)
    return F.when(number == F.floor(number), number.try_cast("int"))


def _list(v: Column, path: str) -> Column:
    return F.when(F.startswith(_type(v, path), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>"))


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(_type(v, path) == "STRING", F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _optional_text(v: Column, path: str) -> Column:
    return _absent(v, path) | _is_text(v, path)


def _optional(v: Column, path: str, value: Column) -> Column:
    return _absent(v, path) | value.isNotNull()


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_type(v), F.lit("OBJECT")), F.lit(False))


def _message_problem(messages: Column) -> Column:
    """Texts must be texts: no numbers, lists of parts or nulls."""
    role = lambda m: _is_text(m, "$.role") & F.coalesce(_text(m, "$.role").isin(S.ROLES), F.lit(False))
    return (
        F.when(~F.forall(messages, role), "bad role")
        .when(F.exists(messages, lambda m: _absent(m, "$.content")), "content missing")
        .when(~F.forall(messages, lambda m: _is_text(m, "$.content")), "bad content")
    )


def _problem(v: Column) -> Column:
    """The first rule a request breaks, null for a good one."""
    messages = _list(v, "$.messages")
    numbers = _optional(v, "$.temperature", _number(v, "$.temperature")) & _optional(v, "$.top_p", _number(v, "$.top_p"))
    return (
        F.when(~_is_object(v), "malformed")
        .when(_absent(v, "$.model"), "model missing")
        .when(~_is_text(v, "$.model"), "bad model")
        .when(messages.isNull(), "messages missing")
        .when(_message_problem(messages).isNotNull(), _message_problem(messages))
        .when(~numbers | ~_optional(v, "$.max_tokens", _whole(v, "$.max_tokens")), "bad number")
        .when(~_optional_text(v, "$.user"), "bad user")
    )


def _message(m: Column) -> Column:
    return F.struct(_text(m, "$.role").alias("role"), _text(m, "$.content").alias("content"))


def parse_requests(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split request documents into typed rows and a quarantine with the reason.

    Texts must be JSON strings; numbers may also come as numeric text, and whole ones as 5.0. An
    empty message list is legal. Other columns of ``df`` are kept on both sides.
    """
    parsed = parsed_once(df, body, "doc").withColumn("problem", _problem(F.col("doc")))
    others = [c for c in df.columns if c != body]
    v = F.col("doc")
    valid = parsed.filter(F.col("problem").isNull()).select(
        *others,
        _text(v, "$.model").alias("model"),
        F.transform(_list(v, "$.messages"), _message).alias("messages"),
        _number(v, "$.temperature").alias("temperature"),
        _whole(v, "$.max_tokens").alias("max_tokens"),
        _number(v, "$.top_p").alias("top_p"),
        _text(v, "$.user").alias("user"),
    )
    quarantine = parsed.filter(F.col("problem").isNotNull()).select(*others, body, "problem")
    return valid, quarantine


def _response_problem(v: Column) -> Column:
    choices = _list(v, "$.choices")
    whole = lambda p: _optional(v, p, _whole(v, p))
    counts = whole("$.usage.prompt_tokens") & whole("$.usage.completion_tokens") & whole("$.usage.total_tokens")
    message = lambda c: _is_text(c, "$.message.content") & F.coalesce(_text(c, "$.message.role").isin(S.ROLES), F.lit(False))
    return (
        F.when(~_is_object(v), "malformed")
        .when(~(_is_text(v, "$.id") & _is_text(v, "$.model") & _is_text(v, "$.provider")), "bad field")
        .when(choices.isNull(), "choices missing")
        .when(~F.forall(choices, message), "bad message")
        .when(~F.forall(choices, lambda c: _optional(c, "$.index", _whole(c, "$.index"))), "bad number")
        .when(~counts, "bad number")
    )


def rejected_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Response documents that break the data model, with the reason: a cache must not serve them."""
    parsed = parsed_once(df, body, "doc").withColumn("problem", _response_problem(F.col("doc")))
    return parsed.filter(F.col("problem").isNotNull()).select(*df.columns, "problem")


def parse_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Typed responses; missing token counts are 0, choices without index are number 0.

    Documents that ``rejected_responses`` names give a null where the field is not of its type.
    """
    doc = F.from_json(F.col(body), schemas.RESPONSE_DOC)
    others = [c for c in df.columns if c != body]
    parsed = df.withColumn("doc", doc)
    choices = F.transform(
        F.col("doc.choices"),
        lambda c: F.struct(
            F.coalesce(c["index"], F.lit(0)).alias("index"),
            c["message"].alias("message"),
            c["finish_reason"].alias("finish_reason"),
        ),
    )
    usage = F.struct(
        *[F.coalesce(F.col(f"doc.usage.{f.name}"), F.lit(0)).alias(f.name) for f in schemas.TOKENS.fields]
    )
    return parsed.select(
        *others,
        F.struct(
            F.col("doc.id").alias("id"),
            F.col("doc.model").alias("model"),
            F.col("doc.provider").alias("provider"),
            choices.alias("choices"),
            usage.alias("usage"),
        ).alias("response"),
    )


def flatten_choices(df: DataFrame, response: str = "response", hit: str = "cache_hit") -> DataFrame:
    """One row per answer choice in the client's shape, with the cache tag."""
    others = [c for c in df.columns if c not in (response, hit)]
    r = F.col(response)
    return df.select(*others, r.alias("r"), F.col(hit).alias("x_cache_hit"), F.explode_outer(r["choices"]).alias("c")).select(
        *others,
        F.col("r.id").alias("response_id"),
        F.lit("chat.completion").alias("object"),
        F.col("r.model").alias("response_model"),
        F.col("r.provider").alias("response_provider"),
        "x_cache_hit",
        F.col("c.index").alias("choice_index"),
        F.col("c.message.role").alias("role"),
        F.col("c.message.content").alias("content"),
        F.col("c.finish_reason").alias("finish_reason"),
        F.col("r.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("r.usage.completion_tokens").alias("completion_tokens"),
        F.col("r.usage.total_tokens").alias("total_tokens"),
    )
