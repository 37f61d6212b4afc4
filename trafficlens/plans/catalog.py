"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import replay_catalog, request_catalog, stream_catalog, usage_catalog, vector_catalog

MODULES = [usage_catalog, request_catalog, replay_catalog, vector_catalog, stream_catalog]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
