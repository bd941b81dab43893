"""All queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from . import queries_filters, queries_matching, queries_models, queries_tokens

_MODULES = (queries_filters, queries_matching, queries_models, queries_tokens)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
