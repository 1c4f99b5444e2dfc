"""Stored state between runs: open alerts, risk scores and incidents that a later batch goes on from.

A state is a table with one row per key, cut into buckets of the key's hash and named by manifests. A run reads the
rows of the keys that its batch touches, folds the batch on top of them, and rewrites the buckets in which something
changed, in one commit under the run's key. Repeating a run changes nothing; folding day after day gives what
folding all days at once gives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from secstream.functions.scalar import as_time, gap_micros, micros, severity_name, severity_rank
from secstream.operators.alerts import alert_positions, fold_positions
from secstream.operators.incidents import attached_firings, incident_history
from secstream.operators.risk import risk_scores, scored_firings
from secstream.session import materialise
from secstream.sources.manifest import Live, Manifest

#: Buckets of a state table; a run rewrites those with a changed key.
BUCKETS = 64


class KeyedState:
    """One row per key, upserted under run keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: StructType | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.columns, self.buckets = spark, path, keys, columns, buckets
        self.table = Manifest(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _laid(self, columns: StructType) -> StructType:
        return StructType([*columns, StructField("_bucket", IntegerType())])

    def seen(self, run: str) -> bool:
        return run in self.table.live().runs

    def read(self, columns: StructType | None = None) -> DataFrame:
        columns = columns or self.columns
        return self.table.read(self._laid(columns)).drop("_bucket")

    def of(self, rows: DataFrame, columns: StructType | None = None) -> DataFrame | None:
        """The stored rows of the keys that occur in ``rows``, or None where nothing is stored yet."""
        if not self.table.live().folders:
            return None
        return self.read(columns or self.columns).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")

    def upsert(self, rows: DataFrame, run: str) -> bool:
        """Put ``rows`` in the place of those with the same keys; False if the run was committed before."""
        live = self.table.live()
        if run in live.runs:
            return False
        new = materialise(rows.withColumn("_bucket", self._bucket()), "state-rows")
        touched = {r._bucket for r in new.select("_bucket").distinct().collect()}  # BUCKETS values at most
        old = [f for f, _ in live.folders if int(f.rsplit("=", 1)[1]) in touched]
        if old:
            held = self.table.read(self._laid(rows.schema), set(old).__contains__)
            both = held.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)
        else:
            both = new
        folders = self.table.stage(both.repartition("_bucket"), ["_bucket"])

        def change(now: Live):
            if run in now.runs:
                return None
            if now.number != live.number:
                raise RuntimeError("another run has changed the state meanwhile; fold again")
            return [*((f, r) for f, r in now.folders if f not in set(old)), *((f, run) for f in folders)], {*now.runs, run}

        return self.table.commit(change)


_ENTITY = ["entity_type", "entity_id"]
#: A stored incident, as ``incident_history`` gives it.
INCIDENT = (
    "incident_id string, status string, severity string, title string, entity_type string, entity_id string, risk_score double, opened_at timestamp, "
    "updated_at timestamp, closed_at timestamp, resolution string, opening_rule string, opening_risk double"
)


def merge_stored(old: DataFrame, new: DataFrame, as_of, suppression: str = "30 minutes") -> DataFrame:
    """Stored alerts of two runs as one row each: what opened the row comes from the older part, its context from
    the newer one; severity only rises."""
    opening = ["rule_name", "technique", "threshold", "window_start", "sample_event_ids"]
    rank = severity_rank(F.col("severity"))
    idle = gap_micros(as_time(as_of), F.col("last_detected_at"))
    return (
        old.unionByName(new)
        .groupBy("id", "dedupe_key", "rule_id", *_ENTITY)
        .agg(
            F.min_by(F.struct(*opening), "first_detected_at").alias("_first"),
            F.max_by("context", F.struct("last_detected_at", "first_detected_at")).alias("context"),
            F.min("first_detected_at").alias("first_detected_at"),
            F.max("last_detected_at").alias("last_detected_at"),
            F.sum("occurrences").alias("occurrences"),
            F.max("observed").alias("observed"),
            F.max("window_end").alias("window_end"),
            severity_name(F.max(rank)).alias("severity"),
        )
        .select("*", "_first.*", (idle <= micros(suppression)).alias("active"), F.lit("untriaged").alias("triage"))
        .select(*old.columns)
    )


def merge_risk(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores of two runs: the newer score, the higher peak, and when that was first reached."""
    peak = F.struct("peak_score", -F.unix_micros("peaked_at"))
    return old.unionByName(new).groupBy(*_ENTITY).agg(
        F.max_by("score", "updated_at").alias("score"),
        F.max("peak_score").alias("peak_score"),
        F.max("updated_at").alias("updated_at"),
        F.max_by("peaked_at", peak).alias("peaked_at"),
    )


@dataclass
class Carried:
    """The state tables of one responder, all under one folder."""

    stored: KeyedState
    open_rows: KeyedState
    risk: KeyedState
    incidents: KeyedState
    attached: KeyedState

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Carried:
        return cls(
            KeyedState(spark, f"{path}/stored", ["id"]),
            KeyedState(spark, f"{path}/open", ["dedupe_key"]),
            KeyedState(spark, f"{path}/risk", _ENTITY),
            KeyedState(spark, f"{path}/incidents", ["incident_id"]),
            KeyedState(spark, f"{path}/attached", ["stored_id"]),
        )


def fold_run(alerts: DataFrame, requests: DataFrame, state: Carried, run: str, as_of, suppression: str = "30 minutes") -> bool:
    """Fold one batch of alerts and analysts' requests into the stored state; False if the run was folded before.

    The batch must not hold anything earlier than what is stored. ``requests`` are those of ``incident_history``.
    The open rows are committed last, so a run that was cut off is folded again from the state before it: each
    table takes a run once.
    """
    if state.open_rows.seen(run):
        return False
    alerts = materialise(alerts, "run-alerts")
    held_columns = StructType.fromDDL("dedupe_key string, stored_id string, occurrences bigint, last_detected_at timestamp")
    before = _before(state, run)
    held = before.open_rows.of(alerts, held_columns)
    positions = materialise(alert_positions(alerts, suppression, held), "run-positions")

    last = F.struct("detected_at", "alert_id")
    open_now = positions.groupBy("dedupe_key").agg(
        F.max_by("stored_id", last).alias("stored_id"), F.max_by("occurrence", last).alias("occurrences"), F.max("detected_at").alias("last_detected_at")
    )
    folded = fold_positions(positions, as_of, suppression)
    old = before.stored.of(folded, folded.schema)
    state.stored.upsert(folded if old is None else merge_stored(old, folded, as_of, suppression), run)

    risk_columns = StructType.fromDDL("entity_type string, entity_id string, score double, peak_score double, updated_at timestamp, peaked_at timestamp")
    entities = before.risk.of(positions, risk_columns)
    scored = materialise(scored_firings(positions, start=entities), "run-scored")
    new = risk_scores(scored)
    state.risk.upsert(new if entities is None else merge_risk(entities, new), run)

    joined = before.attached.of(scored, StructType.fromDDL("stored_id string"))
    attached = materialise(attached_firings(scored, attached_before=joined), "run-attached")
    state.attached.upsert(attached.select("stored_id").distinct(), run)
    kept, incident = None, StructType.fromDDL(INCIDENT)
    if before.incidents.table.live().folders:
        touched = attached.select(*_ENTITY).union(requests.select(*_ENTITY)).distinct()
        kept = before.incidents.read(incident).join(touched, _ENTITY, "left_semi")
    found, _ = incident_history(attached, requests, kept)
    state.incidents.upsert(found.select(*incident.fieldNames()), run)
    state.open_rows.upsert(open_now, run)
    return True


def _before(state: Carried, run: str) -> Carried:
    """The state as it was before ``run``: a run that was cut off has committed some of its tables already."""
    cut = [s for s in (state.stored, state.risk, state.attached, state.incidents) if s.seen(run)]
    if cut:
        for s in cut:
            s.table.undo(run)
    return state
