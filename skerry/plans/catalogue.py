"""All queries over the catalogue roles of the tables, with their SQL."""

from __future__ import annotations

from skerry.plans import record_queries, search_queries, state_queries, stream_queries, telemetry_queries
from skerry.plans.register import Query

PARTS = (search_queries.query, telemetry_queries.query, state_queries.query, record_queries.query, stream_queries.query)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
