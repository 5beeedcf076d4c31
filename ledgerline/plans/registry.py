"""Registered queries of the analytics engine and their SQL twins."""

from __future__ import annotations

from . import estimation, news, regime, relational, streams, validation

_MODULES = [relational, regime, news, validation, estimation, streams]
FLAGSHIP = "hamilton_filter"


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items() if sql}
