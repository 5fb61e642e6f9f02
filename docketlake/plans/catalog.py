"""The library's queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from docketlake.plans.lenses import lens, with_lenses

MODULES = ["billing", "finance", "network", "mail", "calendar", "text", "records", "practice", "files", "formats"]

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, *lenses: str, sql: str | None = None) -> Callable:
    """Register a function of lens frames as query ``name``."""

    def add(f: Callable) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(*[lens(spark, sf_dir, x) for x in lenses])
        if sql:
            _SQL[name] = with_lenses(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"docketlake.plans.q_{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
