"""Named end-to-end queries."""

from __future__ import annotations

from importlib import import_module

from tallyframe.plans.registry import QUERIES, SQL

_MODULES = ("contests", "tables", "statistics", "series", "clusters")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tallyframe.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
