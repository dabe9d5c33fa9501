"""Named queries: each is a Spark plan over the driver tables plus (when SQL can express it)
an equivalent DuckDB SQL text over the same tables, used as the correctness oracle."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from vulnsift.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, ops: tuple[str, ...] | list[str], sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # workers import vulnsift for the Arrow/pandas steps
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, run, sql, tuple(ops))
        return fn

    return deco
