"""Structured Streaming over the same functions that batches use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators import bronze
from tessera.operators.resolution import shared_folder
from tessera.sources.readers import append_new


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def publish_stream(
    stream: DataFrame, rules: list[bronze.FieldRule], accepted: str, quarantine: str, keys: list[str], checkpoint: str
) -> StreamingQuery:
    """Validate every micro-batch and append its rows to the accepted and quarantine tables.

    Both sinks leave out keys they hold, so a batch that is replayed after a failure adds nothing. What is there is
    processed, then the query stops.
    """

    def publish(batch: DataFrame, _: int) -> None:
        good, bad = bronze.split(bronze.dispose(bronze.field_findings(batch, rules)))
        append_new(good.drop("findings", "disposition"), accepted, keys)
        append_new(bad, quarantine, keys)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_rollup(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Events per hour and type; on a stream, late data counts up to the watermark's delay."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total_value")
    ).select(F.col("w.start").alias("hour_start"), "event_type", "n_events", "total_value")


def roll_up_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """hourly_rollup run as a stream over the files that are there; its last state, as a table in the shared folder."""
    base = shared_folder(spark) + f"/rollup-{uuid.uuid4().hex}"
    state = hourly_rollup(file_stream(spark, path, schema))

    def publish(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/state")

    query = state.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(state.schema).parquet(f"{base}/state")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete", shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there and give its result as a table in memory, for tests and small results."""
    out = shape(stream) if shape else stream
    query = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
