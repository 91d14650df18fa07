"""Typed reads of the durable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivetgraph import schemas


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def jobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.JOBS, fmt)


def failed_outputs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.FAILED_OUTPUTS, fmt)


def build_logs(spark: SparkSession, path: str, *, with_blob: bool = False, fmt: str = "parquet") -> DataFrame:
    """Listings never need the blob, so it is left out of the read unless asked for."""
    logs = read_table(spark, path, schemas.BUILD_LOGS, fmt)
    return logs if with_blob else logs.drop("log_gz")
