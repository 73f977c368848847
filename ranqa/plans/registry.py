"""Registry of named queries: a Spark builder and, where SQL can express it, an
independent DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def register(name: str, covers: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ranqa.session import prepare
            prepare(spark)
            return widen_ints(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = covers
        REGISTRY[name] = Query(name, build, sql, covers)
        return fn
    return deco


def r6(c) -> Column:
    """Round a double to 6 decimals and fold -0.0 into 0.0 (matches the oracle)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def widen_ints(df: DataFrame) -> DataFrame:
    """Report every integral output column as bigint (one integer type across
    engines; values are unchanged)."""
    from pyspark.sql import types as T

    small = (T.IntegerType, T.ShortType, T.ByteType)
    if not any(isinstance(f.dataType, small) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])
