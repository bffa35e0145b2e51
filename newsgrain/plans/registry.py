"""All named queries of the library with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import queries_core, queries_more, queries_serving, queries_stream

MODULES = [queries_core, queries_serving, queries_more, queries_stream]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_core.top_bursty(spark, sf_dir)


def _shipping(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipping(fn) for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
