"""Register of the checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a job under a name, with the DuckDB text it must equal."""

    def register(job):
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register
