"""Names of the engine's own queries and their SQL."""

from __future__ import annotations

from .plans import files, oracles, tables


def queries() -> dict:
    return tables.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
