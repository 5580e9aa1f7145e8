"""The registered query of each operator, and its DuckDB text where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    own = importlib.import_module(__package__)
    found = [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules(own.__path__)]
    return sorted((m for m in found if hasattr(m, "QUERY")), key=lambda m: int(m.QUERY[2:].split("_")[0]))


def queries() -> dict:
    return {m.QUERY: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.SQL for m in _modules() if getattr(m, "SQL", None)}
