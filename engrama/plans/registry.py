"""Queries and SQL of the memory-graph operators."""

from engrama.plans import queries as _queries
from engrama.plans import sql as _sql


def queries() -> dict:
    return dict(_queries.ALL)


def oracle_sql() -> dict:
    return {k: v for k, v in _sql.ALL.items() if k in _queries.ALL}
