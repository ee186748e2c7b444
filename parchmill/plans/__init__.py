"""Named queries over the test tables, each with an independent SQL form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Add a query under its function's name, with its SQL."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE[plan.__name__] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import documents, jobs, memory, rules, sources  # noqa: E402, F401
