"""The registered queries: every module below adds its own when imported."""

from __future__ import annotations

from importlib import import_module

MODULES = ["scalars", "matching", "metrics", "curation", "views", "audits", "io", "live"]


def _load() -> None:
    for name in MODULES:
        import_module(f"boxloom.plans.{name}")


def queries():
    _load()
    from boxloom.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    _load()
    from boxloom.plans.registry import SQL

    return dict(SQL)
