"""Per-account baselines and their population statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secstream.functions.quantiles import exact_percentiles
from secstream.functions.scalar import as_time, at_most, gap_micros, ratio, recent
from secstream.session import materialise


def user_baseline(ev: DataFrame, as_of, days: int = 7) -> DataFrame:
    """What is normal for each account over the last ``days`` days.

    One aggregation with map-side combine. The modal country and hour come from ``mode`` (ties
    take the smallest value), so no ranking per account and no join back is needed.
    """
    failed_login = (F.col("event_action") == "user-login") & (F.col("event_outcome") == "failure")
    hour = F.hour("ts")
    per_user = (
        recent(ev, as_of, days * 86400)
        .filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(F.col("event_action") == "user-login").alias("logins"),
            F.count_if(failed_login).alias("login_failures"),
            F.array_sort(F.collect_set("source_country")).alias("countries"),
            F.mode("source_country", True).alias("primary_country"),
            F.countDistinct("source_ip").cast("int").alias("distinct_source_ips"),
            F.array_sort(F.collect_set("user_agent")).alias("user_agents"),
            F.array_sort(F.collect_set(hour)).alias("active_hours"),
            F.mode(hour, True).alias("peak_hour"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    now = as_time(as_of)
    return per_user.select(
        "user_id",
        now.alias("computed_at"),
        F.lit(days).alias("window_days"),
        "total_events",
        "logins",
        "login_failures",
        F.round(ratio(F.col("login_failures"), F.col("logins")), 4).alias("failure_rate"),
        F.round(F.col("total_events") / F.lit(float(days)), 2).alias("events_per_day"),
        "countries",
        "primary_country",
        F.size("countries").alias("distinct_countries"),
        "distinct_source_ips",
        "user_agents",
        F.size("user_agents").alias("distinct_user_agents"),
        "active_hours",
        "peak_hour",
        "first_seen",
        "last_seen",
        F.round(gap_micros(now, F.col("last_seen")) / F.lit(86_400_000_000.0), 2).alias("dormant_days"),
    )


def baseline_distribution(baseline: DataFrame) -> DataFrame:
    """Shape of the population; p95 over median tells how skewed the accounts are."""
    middle = exact_percentiles(baseline, [], "events_per_day", {"_median": 0.5, "_p95": 0.95})
    stats = baseline.agg(
        F.count("*").alias("accounts"),
        F.round(F.avg("events_per_day"), 1).alias("mean_events_per_day"),
        F.round(F.max("events_per_day"), 1).alias("max"),
        F.round(F.avg("failure_rate"), 4).alias("mean_failure_rate"),
        F.round(F.avg("distinct_countries"), 2).alias("mean_countries"),
    )
    middle = materialise(middle, "percentiles")
    stats = stats.withColumns({c: middle.select(c).scalar() for c in ("_median", "_p95")})
    return stats.select(
        "accounts", "mean_events_per_day", F.round("_median", 1).alias("median"), F.round("_p95", 1).alias("p95"), "max", "mean_failure_rate", "mean_countries"
    ).withColumn("p95_to_median", F.round(ratio(F.col("p95"), F.col("median")), 1))


def baseline_outliers(baseline: DataFrame, show: int = 10) -> DataFrame:
    """The busiest accounts."""
    return (
        baseline.select(
            "user_id", "events_per_day", "failure_rate", "distinct_countries",
            "distinct_source_ips", "primary_country", "dormant_days",
        )
        .orderBy(F.desc("events_per_day"), "user_id")
        .transform(at_most, show)
    )


def latest_per_key(rows: DataFrame, keys: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """Newest row per key. The rank filter becomes a group limit in front of the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), *(tie or []))
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def publish_baselines(baseline: DataFrame) -> DataFrame:
    """Baselines as key/value records for a compacted stream: the latest value per account."""
    value = F.struct(
        "user_id",
        F.date_format("computed_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("computed_at"),
        "window_days", "total_events", "logins", "login_failures", "failure_rate", "events_per_day",
        F.array_sort(F.array_distinct("countries")).alias("countries"),
        "primary_country", "distinct_source_ips",
        F.array_sort(F.array_distinct("user_agents")).alias("user_agents"),
        F.array_sort(F.array_distinct("active_hours")).alias("active_hours"),
        "peak_hour", "dormant_days",
    )
    latest = latest_per_key(baseline, ["user_id"], "computed_at")
    return latest.select(F.col("user_id").alias("key"), F.to_json(value).alias("value"))


def baseline_publish_stats(baseline: DataFrame) -> DataFrame:
    return baseline.agg(
        F.round(F.avg(F.size("countries")), 2).alias("mean_known_countries"),
        F.count_if(F.size("countries") > 1).alias("accounts_with_several"),
    )
