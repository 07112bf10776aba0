"""A registry of named queries, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register_operator(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Add a query; a name is taken once."""
    if name in QUERIES:
        raise ValueError(f"{name!r} is registered")
    QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
    if sql is not None:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        register_operator(name, fn, sql)
        return fn

    return add
