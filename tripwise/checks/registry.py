"""Pairs of Spark query and oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripwise.checks.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named subquery that oracle SQL may use."""
    VIEWS[name] = sql.strip()


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], found)
            found[name] = None


def compose(sql: str) -> str:
    """Prefix the SQL with the subqueries it uses, in order of dependence."""
    found: dict[str, None] = {}
    _needed(sql, found)
    if not found:
        return sql.strip()
    parts = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in found)
    return f"WITH {parts}\n{sql.strip()}"


def check(key: str, sql: str | None = None):
    """Register a query; the function gets the tables of one session and folder."""

    def register(build: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = compose(sql)
        return build

    return register
