"""Data-quality checks, pipeline health and throughput reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secstream.functions.quantiles import exact_percentiles
from secstream.functions.scalar import after, as_time, floor_time, gap_micros, lag_seconds, ratio
from secstream.operators.baseline import latest_per_key

# Name, category, comparison and threshold of each check.
CHECKS = [
    ("freshness_seconds", "liveness", "at_most", 300.0),
    ("max_lag_seconds", "liveness", "at_most", 120.0),
    ("null_user_rate", "correctness", "at_most", 0.001),
    ("null_source_ip_rate", "correctness", "at_most", 0.01),
    ("distinct_users_hourly", "liveness", "at_least", 10.0),
    ("unknown_action_rate", "correctness", "at_most", 0.01),
    ("dead_letters_last_hour", "correctness", "at_most", 0.0),
    ("default_partition_rows", "correctness", "at_most", 0.0),
]
NEVER_FRESH = 999999.0


def _zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def quality_checks(ev: DataFrame, dead: DataFrame, default_rows: DataFrame, as_of) -> DataFrame:
    """One row per check. The events are read once; empty denominators pass with zero."""
    now = as_time(as_of)
    hour = after("ts", as_of, "1 hour")
    recent = F.count_if(hour)
    organic = after("ingested_at", as_of, "10 minutes") & F.col("labels").isNull()
    lag = F.when(organic, lag_seconds())
    one = ev.filter((F.col("ts") <= now) | F.col("ts").isNull()).agg(
        F.coalesce(gap_micros(now, F.max("ts")) / F.lit(1e6), F.lit(NEVER_FRESH)).alias("freshness_seconds"),
        _zero(F.max(lag)).alias("max_lag_seconds"),
        _zero(ratio(F.count_if(hour & F.col("user_id").isNull()), recent)).alias("null_user_rate"),
        _zero(ratio(F.count_if(hour & F.col("source_ip").isNull()), recent)).alias("null_source_ip_rate"),
        _zero(F.countDistinct(F.when(hour, F.col("user_id")))).alias("distinct_users_hourly"),
        _zero(ratio(F.count_if(hour & (F.col("event_action") == "unknown")), recent)).alias("unknown_action_rate"),
    )
    late = dead.filter(after("failed_at", as_of, "1 hour")).agg(F.count("*").cast("double")).scalar()
    stranded = default_rows.agg(F.count("*").cast("double")).scalar()
    one = one.withColumn("dead_letters_last_hour", late).withColumn("default_partition_rows", stranded)
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(category).alias("category"),
            (F.col(name) <= limit if how == "at_most" else F.col(name) >= limit).alias("passed"),
            F.round(name, 6).alias("observed"),
            F.lit(limit).alias("threshold"),
        )
        for name, category, how, limit in CHECKS
    ]
    return one.select(F.inline(F.array(*rows))).withColumn("checked_at", now)


def quality_latest(history: DataFrame) -> DataFrame:
    """Newest row per check."""
    return latest_per_key(history, ["check_name"], "checked_at")


def blocking_checks(checks: DataFrame) -> DataFrame:
    """Failing checks; correctness blocks maintenance, liveness only warns."""
    return checks.filter(~F.col("passed")).withColumn("blocks", F.col("category") == "correctness")


def pipeline_state(ev: DataFrame, as_of) -> DataFrame:
    """Rows stored in the last minute, and lag over the last two."""
    lag = lag_seconds()
    return ev.filter(after("ingested_at", as_of, "2 minutes")).agg(
        F.count_if(after("ingested_at", as_of, "1 minute")).alias("rows_last_minute"),
        F.round(_zero(F.max(lag)), 2).alias("max_lag_s"),
        F.round(_zero(F.avg(lag)), 2).alias("avg_lag_s"),
    )


def keep_up_report(samples: DataFrame, enough: float = 0.95) -> DataFrame:
    """Per offered rate: what was achieved, and whether lag grew while the rate was held.

    ``samples`` has ``offered_rate, at, ingested`` (running total) and ``max_lag_s``.
    """
    report = samples.groupBy("offered_rate").agg(
        (F.max_by("ingested", "at") - F.min_by("ingested", "at")).alias("_rows"),
        (gap_micros(F.max("at"), F.min("at")) / F.lit(1e6)).alias("_secs"),
        F.round(F.max("max_lag_s"), 2).alias("max_lag_s"),
        (F.max_by("max_lag_s", "at") - F.min_by("max_lag_s", "at")).alias("_trend"),
    )
    middle = exact_percentiles(samples, ["offered_rate"], "max_lag_s", {"_median": 0.5})
    report = report.join(middle, "offered_rate", "left")
    achieved = ratio(F.col("_rows"), F.col("_secs"))
    return report.select(
        "offered_rate",
        F.round(achieved, 1).alias("achieved_rate"),
        F.round(ratio(achieved, F.col("offered_rate")), 3).alias("keep_up_ratio"),
        "max_lag_s",
        F.round("_median", 2).alias("median_lag_s"),
        F.round("_trend", 1).alias("lag_trend_s"),
        (F.col("_trend") >= 5).alias("lag_growing"),
    ).withColumn("keeps_up", F.col("keep_up_ratio") >= enough)


def breaking_point(report: DataFrame) -> DataFrame:
    """The lowest offered rate that was not kept up with."""
    return report.filter(~F.col("keeps_up")).agg(F.min("offered_rate").alias("breaking_rate"))


def minute_counts(rows: DataFrame, at: str, name: str) -> DataFrame:
    return rows.groupBy(floor_time(F.col(at), "1 minute").alias("minute")).agg(
        F.count("*").alias(name)
    )


def pipeline_health(
    ev: DataFrame, dead: DataFrame, quiet_minutes: int = 3, dlq_minutes: int = 15, max_lag: float = 120.0
) -> DataFrame:
    """Minutes at which the pipeline should have raised an alarm.

    Works on counts per minute: ingest silent for ``quiet_minutes``, any dead letter within
    ``dlq_minutes``, or lag above the bound. One row per minute between first and last activity.
    """
    counts = ev.groupBy(floor_time(F.col("ingested_at"), "1 minute").alias("minute")).agg(
        F.count("*").alias("ingested"), F.max(lag_seconds()).alias("max_lag_s")
    )
    failed = minute_counts(dead, "failed_at", "dead")
    spine = (
        ev.agg(F.min("ingested_at").alias("lo"), F.max("ingested_at").alias("hi"))
        .select(
            F.explode(
                F.sequence(
                    F.date_trunc("minute", "lo"), F.date_trunc("minute", "hi"), F.expr("INTERVAL 1 MINUTE")
                )
            ).alias("minute")
        )
    )
    joined = spine.join(counts, "minute", "left").join(failed, "minute", "left").na.fill(0, ["ingested", "dead"])
    # Minutes of one day are at most 1440 rows; the rows that a frame needs from the day before
    # come along as copies.
    reach = max(quiet_minutes, dlq_minutes) - 1
    day = F.to_date("minute")
    tail = joined.filter(F.hour("minute") * 60 + F.minute("minute") >= 1440 - reach)
    laid = joined.select("*", day.alias("_day"), F.lit(True).alias("_own")).unionByName(
        tail.select("*", F.date_add(day, 1).alias("_day"), F.lit(False).alias("_own"))
    )

    def back(minutes: int):
        return Window.partitionBy("_day").orderBy("minute").rowsBetween(-(minutes - 1), 0)

    silent = (F.sum("ingested").over(back(quiet_minutes)) == 0) & (
        F.count("*").over(back(quiet_minutes)) == quiet_minutes
    )
    return (
        laid.select(
            "minute", "ingested", "_own",
            silent.alias("ingestion_stopped"),
            (F.sum("dead").over(back(dlq_minutes)) > 0).alias("dead_letter_backlog"),
            F.coalesce(F.col("max_lag_s") > max_lag, F.lit(False)).alias("lag_over_bound"),
        )
        .filter("_own")
        .drop("_own")
        .filter("ingestion_stopped or dead_letter_backlog or lag_over_bound")
    )


def ingest_counters(ev: DataFrame, dead: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Ingested, rejected and duplicate messages per minute."""
    parts = [
        minute_counts(ev, "ingested_at", "ingested"),
        minute_counts(dead, "failed_at", "rejected"),
        minute_counts(duplicates, "ingested_at", "duplicates"),
    ]
    names = ["ingested", "rejected", "duplicates"]
    long = None
    for part, name in zip(parts, names):
        row = part.select(
            "minute", *[(F.col(n) if n == name else F.lit(0).cast("long")).alias(n) for n in names]
        )
        long = row if long is None else long.unionByName(row)
    return long.groupBy("minute").agg(*[F.sum(n).alias(n) for n in names])


def batch_latency(progress: DataFrame) -> DataFrame:
    """Percentiles of micro-batch time; ``progress`` has ``batch_id`` and ``duration_ms``."""
    return exact_percentiles(progress, [], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
