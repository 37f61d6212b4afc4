"""Chat messages: canonical hash, last user turn, reshaping for another provider."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def request_hash(model: Column, messages: Column, temperature: Column, top_p: Column, max_tokens: Column) -> Column:
    """SHA-256 over the sorted compact JSON of the five fields that shape the answer."""
    canonical = F.struct(
        max_tokens.alias("max_tokens"),
        F.transform(
            messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))
        ).alias("messages"),
        model.alias("model"),
        temperature.alias("temperature"),
        top_p.alias("top_p"),
    )
    return F.sha2(F.to_json(canonical, {"ignoreNullFields": "false"}), 256)


def request_hash_py(model: Column, messages: Column, temperature: Column, top_p: Column, max_tokens: Column) -> Column:
    """The same hash with Python's JSON text, byte for byte, to share keys with a foreign cache."""
    return _python_hash(model, F.to_json(messages), temperature, top_p, max_tokens)


@F.pandas_udf(T.StringType())
def _python_hash(
    model: pd.Series, messages: pd.Series, temperature: pd.Series, top_p: pd.Series, max_tokens: pd.Series
) -> pd.Series:
    import hashlib

    def one(m, msgs, t, p, n):
        doc = {
            "model": m,
            "messages": [{"role": x.get("role"), "content": x.get("content")} for x in json.loads(msgs)],
            "temperature": None if pd.isna(t) else float(t),
            "top_p": None if pd.isna(p) else float(p),
            "max_tokens": None if pd.isna(n) else int(n),
        }
        text = json.dumps(doc, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    return pd.Series([one(*row) for row in zip(model, messages, temperature, top_p, max_tokens)])


def last_user_message(messages: Column) -> Column:
    """Text of the last turn whose role is user, null where there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def system_instruction(messages: Column) -> Column:
    """All system turns joined by newlines, null where there is none."""
    parts = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def contents(messages: Column) -> Column:
    """The other turns in order, with the assistant renamed to model."""
    return F.transform(
        F.filter(messages, lambda m: m["role"] != "system"),
        lambda m: F.struct(
            F.when(m["role"] == "user", F.lit("user")).otherwise(F.lit("model")).alias("role"),
            F.array(m["content"]).alias("parts"),
        ),
    )


def parse_order(csv: Column) -> Column:
    """A comma list as an array of trimmed, non-empty names."""
    return F.filter(F.transform(F.split(csv, ","), lambda s: F.trim(s)), lambda s: s != "")
