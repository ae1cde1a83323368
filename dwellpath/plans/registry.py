"""All registered queries of the timeline operators and their SQL."""

from __future__ import annotations

from dwellpath.plans import import_queries, lookup_queries, trip_queries

_MODULES = (trip_queries, lookup_queries, import_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
