"""Registry of named queries over the driver tables.

Each entry pairs a Spark plan ``fn(spark, sf_dir) -> DataFrame`` with an
optional ANSI SQL statement that computes the same result in DuckDB over the
same tables (the correctness oracle).  Floating columns are rounded to 6
digits on both sides; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from hexlens.plans import corpus, families, joins, metrics, pe, pe_corpus, scan, training  # noqa: F401
    return REGISTRY
