"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the operator is SQL-expressible, its DuckDB oracle SQL.

Every query reads the driver tables (or data Spark derives from them) in
whole; results carry aliased columns whose names equal the oracle's.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules registers their queries
    from . import queries, stored_queries  # noqa: F401
    return REGISTRY
