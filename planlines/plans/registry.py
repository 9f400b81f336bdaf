"""Registry of the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planlines.plans.inputs import Inputs
from planlines.plans.sql import with_relations

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` may use any relation of ``plans.sql`` by name."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_texts() -> dict[str, str]:
    return {name: with_relations(body) for name, body in SQL.items()}
