"""The library's own queries by name, each with its DuckDB form."""

from __future__ import annotations

from importlib import import_module

MODULES = ("aggregates", "windows", "filters", "ranking", "joins", "setops", "scalars", "scans", "mutations", "machines", "sources", "extensions", "textindex", "extraction", "imports", "edits")


def _load() -> None:
    for m in MODULES:
        import_module(f"tessella.plans.queries_{m}")


def queries() -> dict:
    from tessella.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    from tessella.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
