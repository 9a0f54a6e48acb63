"""Registered queries: every operator over the given tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the DuckDB SQL it has to equal."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


MODULES = (
    "layout_queries",
    "text_queries",
    "header_queries",
    "segment_queries",
    "output_queries",
    "correction_queries",
    "run_queries",
    "source_queries",
)


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
