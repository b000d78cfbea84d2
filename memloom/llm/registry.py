"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from memloom.llm import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(q.SQL)
