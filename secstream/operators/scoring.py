"""Precision and recall of the detections against labelled attack runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.functions.ordered import any_overlap
from secstream.functions.scalar import after, as_time, f1, ratio, recent, seconds
from secstream.session import materialise
from secstream.sources.manifest import Manifest

RUN = ["scenario", "run_id"]
ENTITY = ["entity_type", "entity_id"]


def _labelled(ev: DataFrame, as_of, window: str, tolerance: str) -> DataFrame:
    """Labelled events of the wider look-back: alerts may refer to attacks before the window."""
    reach = 3 * seconds(window) + 2 * seconds(tolerance)
    label = F.col("labels")
    return recent(ev, as_of, reach).filter(F.map_contains_key("labels", F.lit("scenario"))).select(
        label["scenario"].alias("scenario"),
        label["run_id"].alias("run_id"),
        label["attack_technique"].alias("technique"),
        "user_id",
        "source_ip",
        "ts",
    )


def attack_ground_truth(
    ev: DataFrame, as_of, window: str = "6 hours", tolerance: str = "20 minutes"
) -> DataFrame:
    """One row per attack run: who and what it touched, when, how many events."""
    return _labelled(ev, as_of, window, tolerance).groupBy(*RUN, "technique").agg(
        F.array_sort(F.collect_set("user_id")).alias("users"),
        F.array_sort(F.collect_set("source_ip")).alias("source_ips"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count("*").alias("events"),
    )


def attack_entities(labelled: DataFrame) -> DataFrame:
    """``run, technique, entity, started, ended``: one row per run and entity it touched."""
    run = [*RUN, "technique"]
    touched = labelled.select(
        *run, "ts",
        F.explode(
            F.array(
                F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id")),
                F.struct(F.lit("source_ip").alias("entity_type"), F.col("source_ip").alias("entity_id")),
            )
        ).alias("e"),
    ).groupBy(*run, "e.entity_type", "e.entity_id").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    touched = materialise(touched, "touched")  # the events are read once for both
    spans = touched.groupBy(*run).agg(F.min("_from").alias("started"), F.max("_to").alias("ended"))
    return touched.filter(F.col("entity_id").isNotNull()).drop("_from", "_to").join(spans, run)


def _matching(ev, stored, as_of, window, tolerance):
    entities = attack_entities(_labelled(ev, as_of, window, tolerance))
    alerts = stored.filter(after("last_detected_at", as_of, window)).select(
        "id", "rule_id", *ENTITY, F.col("first_detected_at").alias("started"), F.col("last_detected_at").alias("ended")
    )
    return entities, alerts


def matched_alerts(ev, stored, as_of, window: str = "6 hours", tolerance: str = "20 minutes") -> DataFrame:
    """Alerts of the window with ``matched``: landed on an entity while it was under attack."""
    entities, alerts = _matching(ev, stored, as_of, window, tolerance)
    return any_overlap(
        alerts, entities.select(*ENTITY, "started", "ended"), ENTITY, "started", "ended", tolerance, "matched"
    )


def detected_runs(ev, stored, as_of, window: str = "6 hours", tolerance: str = "20 minutes") -> DataFrame:
    """Attack runs that started in the window with ``detected``: some alert overlapped them."""
    entities, alerts = _matching(ev, stored, as_of, window, tolerance)
    begin = as_time(as_of) - F.expr(f"INTERVAL {seconds(window)} SECONDS")
    hit = any_overlap(
        entities.filter(F.col("started") >= begin),
        alerts.select(*ENTITY, "started", "ended"),
        ENTITY, "started", "ended", tolerance, "hit",
    )
    return hit.groupBy(*RUN).agg(F.max("hit").alias("detected"))


def score_rules(matched: DataFrame) -> DataFrame:
    tp, all_alerts = F.count_if("matched"), F.count("*")
    return matched.groupBy("rule_id").agg(
        tp.alias("tp"), F.count_if(~F.col("matched")).alias("fp"), ratio(tp, all_alerts).alias("precision")
    )


def score_scenarios(runs: DataFrame) -> DataFrame:
    found = F.count_if("detected")
    return runs.groupBy("scenario").agg(
        F.count("*").alias("runs"),
        found.alias("detected"),
        F.count_if(~F.col("detected")).alias("missed"),
        ratio(found, F.count("*")).alias("recall"),
    )


def score_overall(matched: DataFrame, runs: DataFrame) -> DataFrame:
    def one(df: DataFrame, value):
        return df.agg(value).scalar()

    line = matched.sparkSession.range(1).select(
        one(matched, F.count_if("matched")).alias("tp"),
        one(matched, F.count_if(~F.col("matched"))).alias("fp"),
        one(runs, F.count_if("detected")).alias("detected"),
        one(runs, F.count("*")).alias("runs"),
    )
    return line.select(
        "*",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("detected"), F.col("runs")).alias("recall"),
    ).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def undetected_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("detected")).select(*RUN)


HISTORY = (
    "scored_at timestamp, window_hours double, rule_id string, scenario string, true_positives long, false_positives long, "
    "false_negatives long, precision double, recall double, f1 double"
)


def score_history_rows(rules: DataFrame, scenarios: DataFrame, as_of, window: str) -> DataFrame:
    """Rows of a scoring run in the form of the score history table."""
    none = F.lit(None).cast("double")
    head = [as_time(as_of).alias("scored_at"), (F.lit(seconds(window)) / 3600.0).alias("window_hours")]
    per_rule = rules.select(
        *head, "rule_id", F.lit(None).cast("string").alias("scenario"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        F.lit(0).cast("long").alias("false_negatives"), "precision", none.alias("recall"), none.alias("f1"),
    )
    per_scenario = scenarios.select(
        *head, F.lit(None).cast("string").alias("rule_id"), "scenario",
        F.col("detected").alias("true_positives"), F.lit(0).cast("long").alias("false_positives"),
        F.col("missed").alias("false_negatives"), none.alias("precision"), "recall", none.alias("f1"),
    )
    return per_rule.unionByName(per_scenario)


def append_score_history(rows: DataFrame, path: str, run: str | None = None) -> bool:
    """Append a scoring run under its key, by default the moment it scored; the same run again adds nothing."""
    rows = materialise(rows, "score-rows")
    if run is None:
        head = rows.select("scored_at", "window_hours").first()
        run = f"{head.scored_at.isoformat()}/{head.window_hours}" if head else "nothing"
    return Manifest(rows.sparkSession, path).append(rows, run)


def read_score_history(spark: SparkSession, path: str) -> DataFrame:
    return Manifest(spark, path).read(HISTORY)
