"""Table constraints as checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from .keys import orphans


@dataclass
class Rules:
    """What must hold for one table."""

    not_null: list[str] = field(default_factory=list)
    max_length: dict[str, int] = field(default_factory=dict)
    domain: dict[str, list[str]] = field(default_factory=dict)
    vector_dim: dict[str, int] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    foreign: dict[str, DataFrame] = field(default_factory=dict)


# Constraints of the tables.
USAGE_RULES = Rules(
    not_null=[
        "id", "request_id", "api_key_id", "model", "provider", "status", "cache_hit", "created_at",
        "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "latency_ms",
    ],
    max_length={"request_id": 64, "model": 128, "provider": 64, "status": 32},
    domain={"cache_hit": S.CACHE_LAYERS, "status": S.STATUSES},
    unique=["id"],
)
KEY_RULES = Rules(
    not_null=["id", "name", "key_prefix", "is_admin", "created_at"],
    max_length={"name": 255, "key_prefix": 32, "user_email": 255},
    unique=["id", "key_prefix"],
)
JOB_RULES = Rules(
    not_null=["id", "api_key_id", "kind", "status", "created_at"],
    domain={"kind": S.JOB_KINDS, "status": S.JOB_STATUSES},
    unique=["id"],
)
RESPONSE_RULES = Rules(
    not_null=["request_hash", "model", "messages", "response", "prompt_tokens", "completion_tokens", "created_at"],
    max_length={"request_hash": 64, "model": 128},
    unique=["request_hash"],
)
ENTRY_RULES = Rules(
    not_null=["id", "request_hash", "embedding", "prompt_text", "model", "created_at"],
    max_length={"request_hash": 64, "model": 128},
    vector_dim={"embedding": S.EMBEDDING_DIM},
    unique=["id"],
)


def _row_checks(rules: Rules) -> list[tuple[str, Column]]:
    checks = [(f"not_null:{c}", F.col(c).isNull()) for c in rules.not_null]
    checks += [(f"max_length:{c}", F.length(c) > n) for c, n in rules.max_length.items()]
    checks += [(f"domain:{c}", ~F.col(c).isin(v)) for c, v in rules.domain.items()]
    checks += [(f"vector_dim:{c}", F.size(c) != n) for c, n in rules.vector_dim.items()]
    return checks


def quality_report(df: DataFrame, rules: Rules) -> DataFrame:
    """Violations per check. All row checks share one scan; keys are checked by aggregates and joins."""
    checks = _row_checks(rules)
    parts = []
    if checks:
        items = F.array(
            *[
                F.struct(F.lit(name).alias("check"), F.count_if(F.coalesce(bad, F.lit(False))).alias("violations"))
                for name, bad in checks
            ]
        )
        parts.append(df.agg(items.alias("c")).select(F.inline("c")))
    for c in rules.unique:
        dup = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(
            dup.agg(F.count("*").alias("violations")).select(F.lit(f"unique:{c}").alias("check"), "violations")
        )
    for c, parent in rules.foreign.items():
        # one row per referenced value before the join, however often it is referenced
        refs = df.groupBy(c).agg(F.count("*").alias("n"))
        bad = orphans(refs, parent, c).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        parts.append(bad.select(F.lit(f"foreign:{c}").alias("check"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
