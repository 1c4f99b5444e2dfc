"""Message streams and idempotent sinks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

import secstream
from secstream import schema
from secstream.session import STREAM_STATE_PROVIDER


def kafka_messages(spark: SparkSession, servers: str, topic: str, per_trigger: int = 3_000_000) -> DataFrame:
    """Messages of a broker topic from the earliest offset. Needs the Kafka connector package."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select(
            "topic", "partition", "offset",
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("arrived_at"),
        )
    )


def file_messages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Messages landed as Parquet files."""
    return spark.readStream.schema(schema.MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def file_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Flat events landed as Parquet files."""
    return spark.readStream.schema(schema.FLAT_EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int, parts: list[str] | None = None) -> None:
    """Write one micro-batch under its number: a batch that is run again replaces itself."""
    (
        rows.withColumn("batch", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*(parts or []), "batch")
        .parquet(path)
    )


def reach_package(spark: SparkSession) -> None:
    """Tell Python workers that are started from now on where this package lies. Processors of keyed state run in
    workers that look at nothing else; a cluster without shared folders ships the package with ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(secstream.__file__))))


def start(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str | None = None,
    available_now: bool = True,
    mode: str = "append",
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``each``.

    Keyed state of the library's processors (timers, map state) needs the RocksDB provider, whatever the caller's
    session says; a query keeps the setting it was started with, so the session gets its own back.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STREAM_STATE_PROVIDER)
    try:
        return _started(stream, each, checkpoint, name, available_now, mode)
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _started(stream, each, checkpoint, name, available_now, mode) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "1 second"})).start()


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append detections to the alert table, exactly once per micro-batch."""
    return start(alerts, lambda rows, batch_id: write_batch(rows, path, batch_id), checkpoint, **options)
