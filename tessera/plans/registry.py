"""All registered queries of the reliability operators, and their SQL twins."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixtures import Views, duck

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_whole: dict[str, Callable[[], str]] = {}
_modules = ("scalars", "tables", "audits", "comparisons", "rates", "generation", "layout", "qualification", "page_geometry", "parents", "reports")


def add(name: str, build: Callable[[Views], DataFrame], sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """Register ``build`` over the derived views; ``sql`` says the same for DuckDB over the named views."""
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    if sql is not None:
        _oracles[name] = duck(sql, *views)


def add_whole(name: str, build: Callable[[Views], DataFrame], sql: Callable[[], str]) -> None:
    """Register a query that is made of other queries, with whole SQL, made when it is asked for."""
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
    _whole[name] = sql


def query(name: str) -> Query:
    _load()
    return _queries[name]


def oracle(name: str) -> str:
    _load()
    return _oracles[name]


def _load() -> None:
    for module in _modules:
        if importlib.util.find_spec(f"tessera.plans.{module}"):
            importlib.import_module(f"tessera.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracles | {name: sql() for name, sql in _whole.items()}
