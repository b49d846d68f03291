"""Registry of named queries with their plain-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result in DuckDB SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r6(col: Column | str, name: str | None = None) -> Column:
    """Round to six places, with no negative zero."""
    base = F.col(col) if isinstance(col, str) else col
    out = F.round(base.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or (col if isinstance(col, str) else "value"))


def ts_text(col: Column | str, name: str | None = None) -> Column:
    base = F.col(col) if isinstance(col, str) else col
    out = F.date_format(base, "yyyy-MM-dd HH:mm:ss")
    return out.alias(name or (col if isinstance(col, str) else "ts"))


def big(col: Column | str, name: str | None = None) -> Column:
    base = F.col(col) if isinstance(col, str) else col
    return base.cast("bigint").alias(name or (col if isinstance(col, str) else "n"))


def i4(col: Column | str, name: str | None = None) -> Column:
    base = F.col(col) if isinstance(col, str) else col
    return base.cast("int").alias(name or (col if isinstance(col, str) else "n"))
