"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pkgutil import iter_modules

_queries: dict[str, Callable] = {}
_oracles: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """Decorator: the function becomes query `name`; sql, or what makes it, is its twin for an independent engine."""

    def keep(f: Callable) -> Callable:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return keep


def _load() -> None:
    """Imports the modules that register queries."""
    from echograph import plans

    for m in iter_modules(plans.__path__):
        importlib.import_module(f"echograph.plans.{m.name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql() if callable(sql) else sql for name, sql in _oracles.items()}
