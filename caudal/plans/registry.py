"""All queries of the core and the SQL they are checked against."""

from __future__ import annotations

from caudal.plans import core_queries, eda, lane_queries, operator_queries, pack

MODULES = [core_queries, eda, pack, operator_queries, lane_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
