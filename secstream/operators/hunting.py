"""Analyst queries over the flat events."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secstream.functions.ordered import running_before
from secstream.functions.scalar import (
    at_most,
    floor_time,
    gap_micros,
    in_cidr,
    lag_seconds,
    micros,
    ratio,
    recent,
    seconds,
)
from secstream.session import materialise


def _login(outcome: str | None = None):
    test = F.col("event_action") == "user-login"
    return test if outcome is None else test & (F.col("event_outcome") == outcome)


def ingest_health(ev: DataFrame, as_of, lookback: str = "1 hour") -> DataFrame:
    """Volume and pipeline lag."""
    rows = recent(ev, as_of, lookback)
    # Two distinct counts in one aggregate would multiply every row, so each gets its own pass
    # over a two-column projection.
    ips = rows.agg(F.countDistinct("source_ip")).scalar()
    return rows.agg(
        F.count("*").alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.min("ts").alias("earliest"),
        F.max("ts").alias("latest"),
        F.round(F.avg(lag_seconds()), 3).alias("avg_lag_s"),
        F.round(F.max(lag_seconds()), 3).alias("max_lag_s"),
    ).withColumn("source_ips", ips)


def events_per_minute(ev: DataFrame, as_of, lookback: str = "30 minutes") -> DataFrame:
    return (
        recent(ev, as_of, lookback)
        .groupBy(F.date_trunc("minute", "ts").alias("minute"), "event_outcome")
        .agg(F.count("*").alias("events"))
    )


def duplicate_check(ev: DataFrame, limit: int | None = 10) -> DataFrame:
    """Event ids stored more than once."""
    return (
        ev.groupBy("event_id")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
        .orderBy(F.desc("copies"), "event_id")
        .transform(at_most, limit)
    )


def login_failure_rate(ev: DataFrame, as_of, lookback: str = "1 hour") -> DataFrame:
    failures = F.count_if(F.col("event_outcome") == "failure")
    return recent(ev, as_of, lookback).filter(_login()).agg(
        ratio(failures, F.count("*")).alias("failure_rate"),
        F.count("*").alias("login_attempts"),
    )


def user_activity(ev: DataFrame, as_of, lookback: str = "1 hour", limit: int | None = 20) -> DataFrame:
    return (
        recent(ev, as_of, lookback)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_outcome") == "failure").alias("failures"),
        )
        .orderBy(F.desc("events"), "user_id")
        .transform(at_most, limit)
    )


def user_countries(ev: DataFrame, as_of, lookback: str = "24 hours", limit: int | None = 40) -> DataFrame:
    return (
        recent(ev, as_of, lookback)
        .groupBy("user_id", "source_country")
        .agg(
            F.count("*").alias("events"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .orderBy("user_id", F.desc("events"), "source_country")
        .transform(at_most, limit)
    )


def brute_force_hunt(
    ev: DataFrame, as_of, minutes: int = 15, threshold: int = 10, limit: int | None = None
) -> DataFrame:
    """Accounts with many failed logins. Counted per (account, source) first, so that one account
    or one source with most of the failures is reduced before it is gathered."""
    per_source = (
        recent(ev, as_of, minutes * 60).filter(_login("failure"))
        .groupBy("user_id", "source_ip")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    )
    per_source = materialise(per_source, "failures-by-source")
    found = (
        per_source.groupBy("user_id")
        .agg(
            F.sum("n").alias("failures"),
            F.count("source_ip").alias("distinct_sources"),
            F.min("first").alias("first_attempt"),
            F.max("last").alias("last_attempt"),
        )
        .filter(F.col("failures") >= threshold)
    )
    # sources are listed for the accounts that are reported only
    named = per_source.join(found.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("source_ip")), ", ").alias("sources")
    )
    found = (
        found.join(named, "user_id")
        .withColumn(
            "duration_s", gap_micros(F.col("last_attempt"), F.col("first_attempt")) / F.lit(1e6)
        )
        .orderBy(F.desc("failures"), "user_id")
    )
    return found if limit is None else found.transform(at_most, limit)


def noisy_sources(ev: DataFrame, as_of, minutes: int = 15, threshold: int = 10) -> DataFrame:
    """Sources that try many accounts."""
    return (
        recent(ev, as_of, minutes * 60).filter(_login())
        .groupBy("source_ip", "source_country")
        .agg(
            F.count("*").alias("attempts"),
            F.countDistinct("user_id").alias("distinct_users"),
            F.count_if(F.col("event_outcome") == "success").alias("successes"),
            F.max("ts").alias("last_seen"),
        )
        .filter(F.col("distinct_users") >= threshold)
        .withColumnRenamed("source_ip", "source")
    )


def new_country_logins(
    ev: DataFrame, as_of, max_gap: str = "1 hour", lookback: str = "24 hours", limit: int | None = 20
) -> DataFrame:
    """Successful logins whose country differs from the account's previous login."""
    logins = recent(ev, as_of, lookback).filter(_login("success")).select(
        "user_id", "ts", "event_id", "source_country", "source_ip"
    )
    previous = F.struct(F.col("source_country").alias("country"), F.col("ts").alias("ts"))
    gap = gap_micros(F.col("ts"), F.col("prev_ts"))
    return (
        running_before(logins, ["user_id"], "ts", ["event_id"], {"prev": ("last", previous)})
        .select(
            "user_id",
            F.col("prev.country").alias("prev_country"),
            "source_country",
            F.col("prev.ts").alias("prev_ts"),
            "ts",
            F.col("source_ip").alias("source"),
        )
        .filter((F.col("source_country") != F.col("prev_country")) & (gap < micros(max_gap)))
        .withColumn("gap_s", gap / F.lit(1e6))
        .orderBy(F.desc("ts"), "user_id")
        .transform(at_most, limit)
    )


def brute_force_success(
    ev: DataFrame, as_of, threshold: int = 10, slack: str = "10 minutes", lookback: str = "1 hour"
) -> DataFrame:
    """Logins that succeeded around the last of many failures."""
    failures = (
        recent(ev, as_of, lookback).filter(_login("failure"))
        .groupBy("user_id")
        .agg(F.count("*").alias("preceding_failures"), F.max("ts").alias("last_failure"))
        .filter(F.col("preceding_failures") >= threshold)
    )
    margin = F.expr(f"INTERVAL {seconds(slack)} SECONDS")
    # the last failure lies in the look-back, so no success before it by more than the slack can be a hit
    return (
        recent(ev, as_of, seconds(lookback) + seconds(slack)).filter(_login("success"))
        .select("user_id", "ts", "source_ip", "source_country")
        .join(failures, "user_id")
        .filter(F.col("ts").between(F.col("last_failure") - margin, F.col("last_failure") + margin))
        .select(
            "user_id",
            "preceding_failures",
            F.col("ts").alias("compromise_time"),
            F.col("source_ip").alias("source"),
            "source_country",
        )
    )


def attack_inventory(ev: DataFrame) -> DataFrame:
    """Labelled attack runs."""
    label = F.col("labels")
    return (
        ev.filter(label.isNotNull())
        .groupBy(
            label["scenario"].alias("scenario"),
            label["run_id"].alias("run_id"),
            label["attack_technique"].alias("technique"),
        )
        .agg(
            F.count("*").alias("events"),
            F.countDistinct("user_id").alias("users_touched"),
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
        )
    )


def recent_events(ev: DataFrame, as_of, limit: int | None = None, lookback: str = "24 hours") -> DataFrame:
    return (
        recent(ev, as_of, lookback)
        .orderBy(F.desc("ts"), "event_id")
        .transform(at_most, limit)
    )


def entity_pivot(ev: DataFrame, address: str, as_of=None, lookback: str = "30 days") -> DataFrame:
    """Everything that mentions an address or name as a whole, or everything from a CIDR range.

    With ``as_of`` and ``lookback`` only the events of that period, and only their days, are read. The
    columns are looked at first; the text only counts where the value is no part of a longer one.
    """
    rows = ev if as_of is None else recent(ev, as_of, lookback)
    if "/" in address:
        return rows.filter(in_cidr(F.col("source_ip"), address))
    mentions = [F.coalesce(F.col(c) == address, F.lit(False)) for c in ("source_ip", "user_id", "user_name")]
    whole = F.col("raw").contains(address) & F.col("raw").rlike(rf"(?<![\w.:-]){re.escape(address)}(?!\w|[.:-]\w)")
    return rows.filter(reduce(lambda a, b: a | b, [*mentions, F.coalesce(whole, F.lit(False))]))


def cloud_events(ev: DataFrame, limit: int | None = 20) -> DataFrame:
    """The oldest cloud events."""
    return (
        ev.filter(F.col("labels")["cloud_provider"] == "aws").orderBy("ts", "event_id").transform(at_most, limit)
    )


TAMPERING_CALLS = ["StopLogging", "DeleteTrail", "UpdateTrail"]


def trail_tampering(ev: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Calls that switch the audit trail off, per period."""
    return (
        ev.filter(F.col("labels")["cloud_event_name"].isin(TAMPERING_CALLS))
        .groupBy(floor_time(F.col("ts"), period).alias("period_start"))
        .agg(F.count("*").alias("calls"))
        .filter("calls >= 1")
    )


def root_usage(records: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Audit records of the root identity that are not service events, per period."""
    used = (F.col("userIdentity.type") == "Root") & (F.col("eventType") != "AwsServiceEvent")
    return (
        records.filter(used)
        .groupBy(floor_time(F.col("eventTime").try_cast("timestamp"), period).alias("period_start"))
        .agg(F.count("*").alias("calls"))
        .filter("calls >= 1")
    )


def labelled_events(ev: DataFrame, key: str | None = "scenario") -> DataFrame:
    """Events with a given label, or with any label."""
    if key is None:
        return ev.filter(F.col("labels").isNotNull())
    return ev.filter(F.map_contains_key("labels", key))


def late_events(
    ev: DataFrame, key: str, grace: str = "1 minute", arrived: str = "ingested_at"
) -> DataFrame:
    """Events older than the newest event seen before them on the same key, minus the grace."""
    rows = ev.filter(F.col(key).isNotNull()).select(key, "event_id", "ts", arrived)
    seen = running_before(rows, [key], arrived, ["event_id"], {"newest_ts": ("max", F.col("ts"))})
    late_by = gap_micros(F.col("newest_ts"), F.col("ts"))
    return seen.filter(late_by > micros(grace)).withColumn("late_by_s", late_by / F.lit(1e6))


def archive_actions(archive: DataFrame, limit: int | None = 8) -> DataFrame:
    return (
        archive.groupBy("event_action")
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_outcome") == "failure").alias("failures"),
        )
        .orderBy(F.desc("events"), "event_action")
        .transform(at_most, limit)
    )


def archive_sources(archive: DataFrame, limit: int | None = 5) -> DataFrame:
    return (
        archive.groupBy("source_ip", "source_country")
        .agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("distinct_users"))
        .orderBy(F.desc("events"), "source_ip", "source_country")
        .transform(at_most, limit)
    )


def archive_attacks(archive: DataFrame) -> DataFrame:
    """Scenarios preserved in the archive, whose labels are JSON text."""
    scenario = F.get_json_object("labels", "$.scenario")
    return (
        archive.filter(F.col("labels").isNotNull() & scenario.isNotNull())
        .groupBy(scenario.alias("scenario"))
        .agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    )
