"""Credentials and per-key limits (no secrets are verified here)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import settings as S


WHITE = r"(?U)^\s+|\s+$"


def bearer_token(header: Column) -> Column:
    """Token of a ``Bearer <token>`` header; null where it is missing or of another scheme."""
    parts = F.split(header, " ", 2)
    return F.when((F.size(parts) == 2) & (F.lower(parts[0]) == "bearer"), F.regexp_replace(parts[1], WHITE, ""))


def bearer_state(header: Column) -> Column:
    parts = F.split(header, " ", 2)
    return (
        F.when(header.isNull() | (header == ""), "missing")
        .when((F.size(parts) != 2) | (F.lower(parts[0]) != "bearer"), "invalid_scheme")
        .otherwise("token")
    )


def key_prefix(token: Column, tag: str = S.KEY_TAG, extra: int = S.KEY_TAG_EXTRA) -> Column:
    """The public part of a token: the tag and the characters after it; null for foreign tokens."""
    return F.when(F.startswith(token, F.lit(tag)), F.substring(token, 1, len(tag) + extra))


def limit_of(overrides: Column, name: str, default: int) -> Column:
    """A limit from the key's JSON overrides; values <= 0 switch the gate off.

    Numbers are cut to their whole part, true and false are 1 and 0; anything else counts as not
    given (``limit_problem`` names it).
    """
    return F.coalesce(_limit(overrides, name), F.lit(default))


def limit_problem(overrides: Column, name: str) -> Column:
    """The text of an override that is no number, null where it is one or is missing."""
    raw = F.get_json_object(overrides, f"$.{name}")
    return F.when(_limit(overrides, name).isNull(), raw)


def _limit(overrides: Column, name: str) -> Column:
    raw = F.get_json_object(overrides, f"$.{name}")
    number = raw.try_cast("decimal(38,10)")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int")
    return F.when(raw == "true", 1).when(raw == "false", 0).otherwise(whole)
