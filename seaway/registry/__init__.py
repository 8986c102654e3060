"""Queries over the driver's tables, each with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seaway.views import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query; ``sql`` may use any view of ``seaway.views`` by name."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = ctes(sql)
        return fn

    return keep


def load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"seaway.registry.{module}")


MODULES = ["scalars", "cleaning", "tracks", "spatial", "safety", "graphs", "places", "routing", "flows"]
