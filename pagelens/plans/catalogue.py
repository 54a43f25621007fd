"""All queries of the core, and their SQL twins."""

from __future__ import annotations

from pagelens.plans import pieces, problems, quality, records, texts

MODULES = (problems, texts, records, quality, pieces)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
