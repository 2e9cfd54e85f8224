"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(table as a DataFrame)`` under a name, with its plain SQL when there is one."""

    def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(
            prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
        )
        if sql:
            ORACLES[name] = sql
        return fn

    return register
