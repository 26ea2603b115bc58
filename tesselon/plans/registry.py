"""All registered queries of the engine, with their oracle SQL."""

from __future__ import annotations

from . import code, graphs, reports, search

_PARTS = (search, graphs, reports, code)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.ORACLE.items()}
