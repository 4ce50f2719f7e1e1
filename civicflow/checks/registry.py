"""Registry of checks: a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TABLE = re.compile(r"\{(\w+)\}")


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; table names in the oracle stand in braces."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return query

    return register


def duck(sql: str) -> str:
    """SQL text with plain table names, for the oracle."""
    return _TABLE.sub(r"\1", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL that both engines understand over the driver's tables."""
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))
