"""Registered queries: name → Spark query and, where SQL can say it, the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rivetgraph.plans.views import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_columns(df: DataFrame) -> DataFrame:
    """Results in types every comparison understands: UTC wall-clock times without a zone,
    arrays as text joined by ``|``."""

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, **ctes: str):
    """Register ``fn(tables)``; ``ctes`` are further SQL views, usable by each other."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_columns(fn(Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, ctes)
        return fn

    return register
