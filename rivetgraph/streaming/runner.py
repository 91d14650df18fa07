"""Running streams to the end of what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rivetgraph.session import settings, table_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
# fixed value: timers and several states per key need this store
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finish(writer, spark: SparkSession) -> StreamingQuery:
    progress = table_path(spark, "stream-progress")
    with settings(spark, **{STORE_CONF: ROCKS}):
        query = writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain(stream: DataFrame, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append-mode result of all input at hand, as a table."""
    spark = stream.sparkSession
    path = table_path(spark, "stream")
    # digests and other keys stay long in a faster codec
    writer = stream.writeStream.format("parquet").option("path", path).option("compression", "zstd").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    finish(writer, spark)
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, keys: Sequence[str], *, first: bool = False) -> DataFrame:
    """Update-mode result: every change is appended, the newest (or first) per key is read
    back."""
    spark = stream.sparkSession
    path = table_path(spark, "stream-updates")

    def add(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    finish(stream.writeStream.outputMode("update").foreachBatch(add), spark)
    rest = [c for c in stream.columns if c not in keys]
    changes = spark.read.option("basePath", path).parquet(path)
    pick = F.min_by if first else F.max_by
    return changes.groupBy(*keys).agg(pick(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
