"""The registry of queries: name -> plan, and name -> oracle SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the plan of the query `name`, with the SQL that DuckDB must agree with."""

    def add(plan):
        PLANS[name] = plan
        if sql:
            ORACLE[name] = sql
        return plan

    return add
