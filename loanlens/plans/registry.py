from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

MODULES = (
    "ingest", "cleaning", "audits", "aggregates", "joins", "ordering", "quality", "drift",
    "fairness", "scoring", "economics", "disparity", "notices", "gates",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"loanlens.plans.{module}")


def n(c: Column | str = None) -> Column:
    """Row count, or count of a 0/1 column, as a 64-bit whole number."""
    return F.count(F.lit(1)) if c is None else F.sum(c).cast("bigint")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so that summation order does not show."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
