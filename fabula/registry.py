"""Registered queries of the engine and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "rrf_fusion"


def query(sql: str | None = None) -> Callable:
    """Register a function of (table), where table(name) reads a table, under its own name; sql: DuckDB SQL for its rows."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


from fabula.plans import queries, queries_story  # noqa: E402, F401  registers
