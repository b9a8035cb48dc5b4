"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "group_relative_advantage"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its equivalent SQL if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered already")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    import importlib
    import pkgutil

    from siftwell.plans import catalog

    for m in pkgutil.iter_modules(catalog.__path__):
        importlib.import_module(f"{catalog.__name__}.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
