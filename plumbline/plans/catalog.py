"""Where queries and the SQL that each is checked against are registered."""

from __future__ import annotations

from .views import oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its DuckDB SQL where it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add
