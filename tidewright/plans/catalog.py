"""All registered queries on the star schema and the event table."""

from __future__ import annotations

from . import graphs, pipelines, relational, streams

GROUPS = (relational.query, pipelines.query, graphs.query, streams.query)


def queries() -> dict:
    return {k: v for g in GROUPS for k, v in g.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for g in GROUPS for k, v in g.sql.items()}
