"""Messages to stored events and dead letters, as a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from secstream import schema
from secstream.operators.ingest import dead_letters, dedupe_events, flatten_events, message_times, parse_events, validate_events
from secstream.operators.lake import day_between, split_by_range, with_day
from secstream.operators.quality import quality_checks
from secstream.session import written
from secstream.streaming.sources import start, write_batch


def stored_events(spark, path: str) -> DataFrame:
    columns = [*schema.FLAT_EVENT, *[schema.T.StructField(p, schema.T.IntegerType()) for p in [*schema.DAY_PARTS, "batch"]]]
    return spark.read.schema(schema.T.StructType(columns)).parquet(path)


def stream_ingest(
    messages: DataFrame, events_path: str, dead_path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Parse, validate, de-duplicate and store each micro-batch.

    Offsets are committed only after a batch's events and dead letters are written, and both are
    written under the batch number, so a repeated batch changes nothing. Events already stored by
    other batches are left out; only the days the batch touches are read for that. Each batch is
    counted where it is parsed, see ``batch_metrics``. It is parsed once, in front of one write: a cached batch may be
    parsed by two executors at the same time, or again after a loss, and would then be counted twice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with written(batch, "ingest-batch") as validated:
            usable = flatten_events(validated.filter(F.col("failure_type").isNull()))
            stored = None
            if _exists(spark, events_path):
                stored = stored_events(spark, events_path).filter(F.col("batch") != batch_id)
            good = dedupe_events(usable, stored).select(*schema.FLAT_COLUMNS)
            write_batch(with_day(good), events_path, batch_id, schema.DAY_PARTS)
            write_batch(dead_letters(validated), dead_path, batch_id)

    counted = validate_events(parse_events(messages)).observe(
        METRICS, F.count("*").alias("received"), F.count("failure_type").alias("rejected")
    )
    return start(counted, each, checkpoint, **options)


METRICS = "ingest"


def batch_metrics(query: StreamingQuery) -> DataFrame:
    """``batch_id, duration_ms, received, rejected`` of the query's recent micro-batches, as its progress reports
    them: the numbers that a dashboard would scrape. Spark keeps ``spark.sql.streaming.numRecentProgressUpdates``."""
    spark = SparkSession.active()
    rows = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(METRICS)
        if seen is not None and p.numInputRows:
            rows.append((p.batchId, p.batchDuration, seen["received"], seen["rejected"]))
    return spark.createDataFrame(rows, "batch_id long, duration_ms long, received long, rejected long")


def stream_times(messages: DataFrame, times_path: str, state_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Event times of a message stream. The newest event time of each partition is kept for the next micro-batch,
    one row a partition and batch, written under the batch number like the times themselves."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = None
        if _exists(spark, state_path):
            earlier = spark.read.parquet(state_path).filter(F.col("batch") < batch_id)
            held = earlier.groupBy("topic", "partition").agg(F.max("stream_time").alias("stream_time"))
        parsed = parse_events(batch).persist()
        try:
            timed = message_times(parsed, held)
            write_batch(timed.select("topic", "partition", "offset", "arrived_at", "time", "time_from"), times_path, batch_id)
            newest = parsed.groupBy("topic", "partition").agg(F.max("event_ts").alias("stream_time"))
            write_batch(newest.filter("stream_time IS NOT NULL"), state_path, batch_id)
        finally:
            parsed.unpersist()

    return start(messages, each, checkpoint, **options)


def _exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stream_dedupe(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an event (same id and time) that arrive within the watermark, with bounded state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id", "ts"])


def stream_quality(
    events: DataFrame, events_path: str, dead_path: str, history_path: str, checkpoint: str, back_days: int = 2, expect_days: int = 40, **options
) -> StreamingQuery:
    """Append quality checks to the check history after every micro-batch.

    The checks look at the stored events of the newest day of the batch and ``back_days`` before it, not at the batch
    alone, so hourly rates mean hours. Events dated more than ``expect_days`` before that day, or after it,
    count as rows of the default partition.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max("ingested_at")).first()[0]
        if newest is None:
            return
        day = newest.date()
        dead = spark.read.schema(schema.DEAD_LETTER).parquet(dead_path)
        recent = stored_events(spark, events_path).filter(day_between(day - dt.timedelta(days=back_days), day))
        stray = split_by_range(batch, day - dt.timedelta(days=expect_days), day)[1]
        write_batch(quality_checks(recent, dead, stray, F.lit(newest)), history_path, batch_id)

    return start(events, each, checkpoint, **options)
