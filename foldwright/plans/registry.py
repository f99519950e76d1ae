"""Query registry: name -> Spark builder, name -> equivalent SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODULES = (
    "columns",
    "folds",
    "features",
    "oof",
    "metrics",
    "rates",
    "studies",
    "resampling",
    "text",
    "runlog",
    "runstate",
    "selection",
    "fits",
    "files",
)


def query(name: str, sql: str | None = None):
    """Register a builder `(tables) -> DataFrame`; without `sql` only its rows can be checked."""

    def register(build):
        from foldwright.plans.fixtures import Tables

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def load_all() -> None:
    for module in _MODULES:
        if importlib.util.find_spec(f"foldwright.plans.{module}"):
            importlib.import_module(f"foldwright.plans.{module}")


def r6(expression: str) -> str:
    """SQL text rounding to 6 digits, with negative zero made positive."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0)"
