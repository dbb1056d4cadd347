"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from pkgutil import iter_modules


def _modules() -> list:
    found = [importlib.import_module(f"{__name__}.{m.name}") for m in iter_modules(__path__)]
    return [m for m in found if hasattr(m, "NAME")]


def queries() -> dict[str, Callable]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
