"""All queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from memloom.plans import analysis, lineage, memory, problems, records, retrieval, streams, texts

MODULES = (problems, retrieval, memory, texts, analysis, lineage, records, streams)
FLAGSHIP = "m06_hybrid_final"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
