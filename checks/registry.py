"""Collects queries and their checking SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Views` under its own name, with its SQL if there is one."""
    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add
