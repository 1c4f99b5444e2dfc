"""Stored alerts: repeated firings folded into one row, triage, listings and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secstream.functions.ordered import running_before
from secstream.functions.scalar import (
    after,
    as_time,
    at_most,
    floor_time,
    gap_micros,
    micros,
    ratio,
    severity_name,
    severity_rank,
)
from secstream.operators.baseline import latest_per_key
from secstream.operators.rules import Rule
from secstream.operators.sequence import DEVIATION, HIJACK, TRAVEL
from secstream.session import materialise

# Analyst verdicts and the techniques of the detections that are not rules.
VERDICTS = ["true_positive", "false_positive", "benign", "untriaged"]
SEQUENCE_TECHNIQUES = {TRAVEL: "T1078", HIJACK: "T1539", DEVIATION: "T1078"}


def alert_union(*parts: DataFrame) -> DataFrame:
    """All detections as one alert table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def alert_positions(alerts: DataFrame, suppression: str = "30 minutes", held: DataFrame | None = None) -> DataFrame:
    """Add ``stored_id`` (the alert that opened the row a firing folds into) and ``occurrence``.

    A gap longer than the suppression window on the same dedupe key opens a new row. ``held`` has the rows that
    earlier batches left open: ``dedupe_key, stored_id, occurrences, last_detected_at``. Each stands in front of its
    key as one firing that counts as often as the row has fired.
    """
    rows = alerts.withColumns({"_times": F.lit(1).cast("long"), "_held": F.lit(None).cast("string")})
    if held is not None:
        heads = held.select(
            "dedupe_key", F.col("last_detected_at").alias("detected_at"), F.lit("").alias("alert_id"),
            F.col("occurrences").alias("_times"), F.col("stored_id").alias("_held"),
        )
        rows = rows.unionByName(heads, allowMissingColumns=True)
    first = running_before(
        rows, ["dedupe_key"], "detected_at", ["alert_id"],
        {"_before": ("sum", F.col("_times")), "_last": ("last", F.col("detected_at"))},
    ).withColumn("_before", F.coalesce("_before", F.lit(0)))
    opens = F.col("_last").isNull() | (gap_micros(F.col("detected_at"), F.col("_last")) > micros(suppression))
    opened = F.when(opens, F.struct(F.coalesce("_held", "alert_id").alias("id"), F.col("_before").alias("index")))
    marked = first.withColumn("_opened", opened)
    carried = running_before(
        marked, ["dedupe_key"], "detected_at", ["alert_id"], {"_open": ("last", F.col("_opened"))}
    )
    row = F.coalesce("_opened", "_open")
    return carried.filter(F.col("_held").isNull()).select(
        *alerts.columns,
        row["id"].alias("stored_id"),
        (F.col("_before") - row["index"] + 1).cast("long").alias("occurrence"),
    )


def fold_positions(positions: DataFrame, as_of, suppression: str = "30 minutes") -> DataFrame:
    """One stored alert per ``stored_id``."""
    order = F.struct("detected_at", "alert_id")
    opening = F.min_by(
        F.struct("rule_name", "technique", "threshold", "window_start", "sample_event_ids"), order
    )
    idle = gap_micros(as_time(as_of), F.col("last_detected_at"))
    return (
        positions.groupBy("stored_id", "dedupe_key", "rule_id", "entity_type", "entity_id")
        .agg(
            opening.alias("_first"),
            F.max_by("context", order).alias("context"),
            F.min("detected_at").alias("first_detected_at"),
            F.max("detected_at").alias("last_detected_at"),
            F.count("*").alias("occurrences"),
            F.max("observed").alias("observed"),
            F.max("window_end").alias("window_end"),
            severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        )
        .select(
            F.col("stored_id").alias("id"), "dedupe_key", "first_detected_at", "last_detected_at",
            "occurrences", "rule_id", "_first.rule_name", "severity", "_first.technique",
            "entity_type", "entity_id", "observed", "_first.threshold", "_first.window_start",
            "window_end", "context", "_first.sample_event_ids",
            (idle <= micros(suppression)).alias("active"),
            F.lit("untriaged").alias("triage"),
        )
    )


def fold_alerts(alerts: DataFrame, as_of, suppression: str = "30 minutes") -> DataFrame:
    """Suppress repeats: one row per dedupe key while firings keep coming."""
    return fold_positions(alert_positions(materialise(alerts, "alerts"), suppression), as_of, suppression)


def triage(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Apply the newest valid verdict (``id, verdict, analyst, note, at``) to each stored alert."""
    valid = verdicts.filter(F.col("verdict").isin(VERDICTS))
    newest = latest_per_key(valid, ["id"], "at", ["verdict"]).select(
        "id",
        "verdict",
        F.col("at").alias("triaged_at"),
        F.col("analyst").alias("triaged_by"),
        F.col("note").alias("triage_note"),
    )
    return (
        stored.join(newest, "id", "left")
        .withColumn("triage", F.coalesce("verdict", "triage"))
        .drop("verdict")
    )


def alert_list(
    stored: DataFrame,
    limit: int = 50,
    severity: str | None = None,
    active_only: bool = False,
    verdict: str | None = None,
) -> DataFrame:
    rows = stored
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    if active_only:
        rows = rows.filter("active")
    if verdict is not None:
        rows = rows.filter(F.col("triage") == verdict)
    return rows.orderBy(F.desc("last_detected_at"), "id").transform(at_most, limit)


def rule_stats(stored: DataFrame) -> DataFrame:
    """Volume and analyst verdicts per rule."""
    def verdict(name: str):
        return F.count_if(F.col("triage") == name)

    judged = F.count_if(F.col("triage").isin("true_positive", "false_positive"))
    return stored.groupBy("rule_id").agg(
        F.count("*").alias("alerts"),
        F.sum("occurrences").alias("firings"),
        verdict("true_positive").alias("true_positives"),
        verdict("false_positive").alias("false_positives"),
        verdict("untriaged").alias("untriaged"),
        F.round(ratio(verdict("true_positive"), judged), 3).alias("precision"),
        F.max("last_detected_at").alias("last_fired"),
    )


def attack_coverage(alerts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Technique by technique: which detections exist, how many fired, and which stayed silent."""
    detections = [(r.id, r.technique) for r in rules if r.enabled and r.technique]
    detections += list(SEQUENCE_TECHNIQUES.items())
    table = F.array(
        *[F.struct(F.lit(t).alias("technique"), F.lit(i).alias("detection")) for i, t in detections]
    )
    known = alerts.sparkSession.range(1).select(F.inline(table))
    fired = alerts.groupBy(F.col("rule_id").alias("detection")).agg(F.count("*").alias("alerts"))
    return (
        known.join(fired, "detection", "left")
        .groupBy("technique")
        .agg(
            F.array_join(F.array_sort(F.collect_list("detection")), ",").alias("detections"),
            F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("alerts").isNull(), F.col("detection")))), ","
            ).alias("silent"),
        )
    )


def alert_rates(alerts: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Firings per rule and period."""
    return alerts.groupBy("rule_id", floor_time(F.col("detected_at"), period).alias("period_start")).agg(
        F.count("*").alias("firings")
    )


def alert_share(alerts: DataFrame, as_of, lookback: str = "3 hours") -> DataFrame:
    """Share of each rule in the firings of the last hours."""
    recent = alerts.filter(after("detected_at", as_of, lookback))
    total = recent.agg(F.count("*")).scalar()
    return (
        recent.groupBy("rule_id")
        .agg(F.count("*").alias("firings"))
        .withColumn("share", F.round(ratio(F.col("firings"), total), 4))
    )


def response_counters(
    positions: DataFrame, incidents: DataFrame, as_of, lookback: str = "3 hours"
) -> DataFrame:
    """Incidents opened and firings folded into an open alert in the last hours."""
    opened = incidents.filter(after("opened_at", as_of, lookback)).agg(F.count("*")).scalar()
    recent = positions.filter(after("detected_at", as_of, lookback))
    return recent.agg(
        F.count_if(F.col("occurrence") > 1).alias("alerts_deduplicated")
    ).withColumn("incidents_opened", opened)
