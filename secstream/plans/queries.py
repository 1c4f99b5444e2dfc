"""Every operator as a named query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Outputs are made comparable with plain SQL: times without zone, integers as bigint, lists and maps
as text.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secstream import schema
from secstream.functions import scalar as S
from secstream.functions.fields import ACTIONS, CATEGORIES, OUTCOMES, field, known_or_unknown
from secstream.operators import (
    alerts as A,
    baseline as B,
    carry as K2,
    cloud as C,
    hunting as H,
    incidents as I,
    ingest as G,
    lake as L,
    quality as Q,
    response as R,
    risk as K,
    scoring as V,
    sequence as E,
    threshold as W,
)
from secstream.operators.rules import PACKS, Rule, compile_match, load_rules
from secstream.plans.detection import attach, detect, latest, respond
from secstream.session import materialise, use_utc, work_dir
from secstream.sources import tables
from secstream.streaming import detect as D_STREAM
from secstream.streaming import ingest as I_STREAM
from secstream.streaming import respond as R_STREAM
from secstream.streaming import sources

WEEKLY = load_rules(PACKS / "weekly")
STANDARD = load_rules(PACKS / "standard")
#: 31 days into five minutes.
SQUEEZE = 8928
MONTH = "31 days"
HISTORY_DAYS = 15
WINDOW, TOLERANCE = "10 days", "20 minutes"


def plain(df: DataFrame) -> DataFrame:
    """Column types that a plain SQL engine shares."""
    columns = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.MapType):
            pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
            column = F.array_join(F.array_sort(pairs), ";")
        columns.append(column.alias(f.name))
    return df.select(*columns)


class Lab:
    """The inputs that queries share, derived from one table directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        use_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def ev(self) -> DataFrame:
        return tables.security_events(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        """The events as detections and responses read them, a dozen times over. Written, because a filter on derived
        columns parses the activity's JSON anew for each of its conditions; dealt out first, because a table that came
        in few row groups would leave each of those scans to as few tasks."""
        return materialise(tables.security_events(self.spark, self.sf_dir, dealt=True).drop("raw"), "events")

    @cached_property
    def now(self) -> Column:
        return latest(self.ev)

    @cached_property
    def messages(self) -> DataFrame:
        return tables.messages(self.spark, self.sf_dir)

    @cached_property
    def validated(self) -> DataFrame:
        return G.validate_events(G.parse_events(self.messages))

    @cached_property
    def flat(self) -> DataFrame:
        return G.flatten_events(self.validated.filter(F.col("failure_type").isNull()))

    @cached_property
    def dead(self) -> DataFrame:
        return G.dead_letters(self.validated)

    @cached_property
    def cloud_records(self) -> DataFrame:
        return C.cloud_records(tables.cloud_deliveries(self.spark, self.sf_dir))

    @cached_property
    def cloud(self) -> DataFrame:
        return C.cloud_audit_to_events(self.cloud_records)

    @cached_property
    def baseline(self) -> DataFrame:
        return B.user_baseline(self.ev, self.now, 31)

    @cached_property
    def history(self) -> DataFrame:
        """Baseline of the days before the last half of the month."""
        return self._history(self.ev)

    def _history(self, ev: DataFrame) -> DataFrame:
        then = self.now - F.expr(f"INTERVAL {HISTORY_DAYS} DAYS")
        return B.user_baseline(ev.filter(F.col("ts") <= then), then, HISTORY_DAYS)

    @cached_property
    def alerts(self) -> DataFrame:
        return materialise(detect(self.events, WEEKLY, self._history(self.events)), "alerts")

    @cached_property
    def response(self):
        return respond(self.alerts, self.now, stored=True)

    @cached_property
    def attached(self) -> tuple[DataFrame, DataFrame]:
        """Attached firings and incidents, for those that read no evidence; it is not put together unless others have."""
        if "response" in self.__dict__:
            return self.response.attached, self.response.incidents
        return attach(detect(self.events, WEEKLY, self._history(self.events), evidence=False))

    @cached_property
    def verdicts(self) -> DataFrame:
        """Two analyst verdicts per stored alert, by the second it was first seen."""
        second = F.unix_seconds("first_detected_at")
        pick = F.array(*[F.lit(v) for v in A.VERDICTS])
        rows = F.explode(F.array(F.lit(0), F.lit(1))).alias("round")
        return self.response.stored.select("id", "first_detected_at", second.alias("s"), rows).select(
            "id",
            F.element_at(pick, ((F.col("s") + F.col("round")) % 4 + 1).cast("int")).alias("verdict"),
            F.concat(F.lit("analyst-"), (F.col("s") % 3).cast("string")).alias("analyst"),
            F.lit("reviewed").alias("note"),
            F.timestamp_micros(F.unix_micros("first_detected_at") + F.col("round") * 3_600_000_000).alias("at"),
        )

    @cached_property
    def triaged(self) -> DataFrame:
        return A.triage(self.response.stored, self.verdicts)

    @cached_property
    def incidents(self) -> DataFrame:
        """One row per entity, out of all scored firings: written for those that read it several times."""
        return materialise(self.response.incidents, "incidents")

    @cached_property
    def actions(self) -> DataFrame:
        return materialise(R.propose_actions(self.response.attached, self.incidents), "actions")

    def _requests(self, subjects: DataFrame, key: str, since: str, words: list[str]) -> DataFrame:
        """One request per event of the account after the subject began; the port picks the move."""
        pick = F.array(*[F.lit(w) for w in words])
        events = self.events.select("user_id", "event_id", "ts", "source_port")
        mine = events.join(subjects, "user_id").filter(F.col("ts") > F.col(since))
        return mine.select(
            key,
            F.col("ts").alias("at"),
            F.col("event_id").alias("seq"),
            F.element_at(pick, F.col("source_port") % len(words) + 1).alias("to"),
            F.concat(F.lit("analyst-"), (F.col("source_port") % 3).cast("string")).alias("actor"),
            F.concat(F.lit("note "), "event_id").alias("note"),
        )

    @cached_property
    def transition_requests(self) -> DataFrame:
        users = self.incidents.filter("entity_type = 'user'").select(
            "incident_id", F.col("entity_id").alias("user_id"), "opened_at"
        )
        return self._requests(users, "incident_id", "opened_at", list(I.MOVES))

    @cached_property
    def transitions(self) -> tuple[DataFrame, DataFrame]:
        return I.incident_transitions(self.incidents, self.transition_requests)

    @cached_property
    def entity_requests(self) -> DataFrame:
        """The transition requests by entity, as analysts see one entity over several incidents."""
        users = self.incidents.filter("entity_type = 'user'").select(F.col("entity_id").alias("user_id"), "opened_at")
        rows = self._requests(users, "user_id", "opened_at", list(I.MOVES))
        return rows.select("at", "seq", "to", "actor", "note", F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"))

    @cached_property
    def carried(self) -> K2.Carried:
        """The responder's state after two runs, one for each half of the month; the second run is repeated."""
        state, cut = K2.Carried.at(self.spark, f"{_scratch(self.spark)}/responder"), self.now - F.expr(f"INTERVAL {HISTORY_DAYS} DAYS")
        requests = materialise(self.entity_requests, "entity-requests")
        for run, early in (("first half", True), ("second half", False), ("second half", False)):
            part = [(df.filter(F.col(at) <= cut) if early else df.filter(F.col(at) > cut)) for df, at in ((self.alerts, "detected_at"), (requests, "at"))]
            K2.fold_run(*part, state, run, self.now)
        return state

    @cached_property
    def action_events(self) -> DataFrame:
        users = self.actions.filter("target_type = 'user'").select(
            "action_id", F.col("target_id").alias("user_id"), "proposed_at"
        )
        words = ["approved", "executed", "failed", "rejected", "reverted"]
        return self._requests(users, "action_id", "proposed_at", words).withColumnRenamed("note", "detail")

    @cached_property
    def lifecycle(self) -> tuple[DataFrame, DataFrame]:
        return R.action_lifecycle(self.actions, self.action_events)

    @cached_property
    def trail(self) -> DataFrame:
        return R.audit_trail(self.incidents, self.actions, self.transitions[1], self.triaged, self.lifecycle[1])

    @cached_property
    def archive_path(self) -> str:
        """The whole event table written as a day-partitioned archive."""
        path = f"{_scratch(self.spark)}/archive"
        L.write_days(self.ev, path)
        return path

    @cached_property
    def archive(self) -> DataFrame:
        return L.read_archive(self.spark, self.archive_path)

    @cached_property
    def bursts(self) -> DataFrame:
        """The events of a month squeezed into five minutes and onto a few accounts and addresses: as dense as the
        attacks that rules with windows of minutes are made for."""
        first = self.ev.agg(F.date_trunc("day", F.min("ts"))).scalar()
        inside = F.timestamp_micros(F.unix_micros(first) + F.floor((F.unix_micros("ts") - F.unix_micros(first)) / F.lit(SQUEEZE)))
        account = F.concat(F.lit("u-"), (F.substring("user_id", 3, 5).cast("int") % F.when(F.col("event_action") == "api-key-used", 5).otherwise(50)).cast("string"))
        source = F.when(F.col("source_ip").startswith("203."), "203.0.113.7").otherwise(F.col("source_ip"))
        return self.ev.withColumns({"ts": inside, "user_id": account, "source_ip": source, "service_environment": F.when(F.col("event_category").isin("iam", "api"), "aws").otherwise(F.col("service_environment"))})

    @cached_property
    def standard_alerts(self) -> DataFrame:
        return materialise(W.threshold_alerts(self.bursts, STANDARD), "standard-alerts")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Three appended loads of ten days each."""
        path = f"{_scratch(self.spark)}/snapshots"
        rows = self.ev.select("event_id", "ts", "ingested_at", "event_action")
        for load in (1, 2, 3):
            days = F.least(F.ceil(F.dayofmonth("ts") / 10), F.lit(3))
            L.snapshot_append(rows.filter(days == load), path, load)
        return self.spark.read.parquet(path)

    @cached_property
    def matched(self) -> DataFrame:
        return V.matched_alerts(self.events, self.response.stored, self.now, WINDOW, TOLERANCE)

    @cached_property
    def runs(self) -> DataFrame:
        return V.detected_runs(self.events, self.response.stored, self.now, WINDOW, TOLERANCE)


def _scratch(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/secstream/{uuid.uuid4().hex}"


_labs: dict[tuple[str, str], Lab] = {}


def lab(spark: SparkSession, sf_dir: str) -> Lab:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _labs:
        _labs[key] = Lab(spark, sf_dir)
    return _labs[key]


QUERIES: dict[str, Callable[[Lab], DataFrame]] = {}


def query(name: str | None = None):
    def register(function: Callable[[Lab], DataFrame]):
        QUERIES[name or function.__name__] = function
        return function

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, sf_dir: plain(function(lab(spark, sf_dir)))

    return {name: bind(function) for name, function in QUERIES.items()}


# --- sources and ingest ----------------------------------------------------------------------


@query()
def parse_events(x: Lab) -> DataFrame:
    """Outcome of parsing per message."""
    rows = G.parse_events(x.messages)
    kind = F.regexp_replace("parse_problem", ":.*", "")
    return rows.groupBy(kind.alias("problem"), F.col("event_ts").isNotNull().alias("has_time")).agg(
        F.count("*").alias("messages")
    )


@query()
def normalise_enums(x: Lab) -> DataFrame:
    words = F.upper(F.concat("event_type", F.lit("")))
    action = F.when(F.col("event_type") == "view", F.lit("Token-Issued")).otherwise(words)
    outcome = F.when(F.col("event_type") == "error", "FAILURE").when(F.col("event_type") == "click", "Success")
    category = F.when(F.col("k") < 50, "IAM").otherwise("storage")
    return (
        tables.activity(x.spark, x.sf_dir)
        .select(
            known_or_unknown(action, ACTIONS).alias("action"),
            known_or_unknown(category, CATEGORIES).alias("category"),
            known_or_unknown(outcome, OUTCOMES).alias("outcome"),
        )
        .groupBy("action", "category", "outcome")
        .agg(F.count("*").alias("events"))
    )


@query()
def validate_events(x: Lab) -> DataFrame:
    reason = F.regexp_replace("failure_reason", ":.*", "")
    return x.validated.groupBy("failure_type", reason.alias("reason")).agg(F.count("*").alias("messages"))


@query()
def route_dead_letters(x: Lab) -> DataFrame:
    return x.dead.select(
        "failed_at", "source_topic", "source_partition", "source_offset", "source_key", "failure_type", "replay_count"
    )


@query()
def dlq_archive(x: Lab) -> DataFrame:
    again = x.dead.withColumn("failed_at", F.col("failed_at") + F.expr("INTERVAL 1 HOUR"))
    return G.dlq_archive(x.dead.unionByName(again)).select(
        "failed_at", "source_topic", "source_partition", "source_offset", "failure_type"
    )


@query()
def dlq_replay(x: Lab) -> DataFrame:
    """Replay all dead letters; all of them still fail."""
    outcome = G.dlq_replay(x.dead, as_of=x.now)
    return outcome.bookkeeping.groupBy("failure_type", "replay_count").agg(F.count("*").alias("letters"))


@query()
def event_times(x: Lab) -> DataFrame:
    """The time each message counts under, and where it comes from."""
    return G.message_times(G.parse_events(x.messages)).select("partition", "offset", "time", "time_from")


@query()
def dlq_list(x: Lab) -> DataFrame:
    return G.dlq_list(x.dead, "VALIDATION_ERROR", 50).select(
        "failed_at", "source_partition", "source_offset", "failure_reason", F.length("preview").alias("preview_chars")
    )


@query()
def dlq_summary(x: Lab) -> DataFrame:
    return G.dlq_summary(x.dead)


@query()
def dedupe_events(x: Lab) -> DataFrame:
    """First arrivals only: each stored event with the arrival that won."""
    return G.dedupe_events(x.flat).select("event_id", "ts", "ingested_at", "offset")


@query()
def dedupe_against_stored(x: Lab) -> DataFrame:
    """Arrivals that are not among the events stored in the first half of the month."""
    stored = L.with_day(x.ev).filter(F.col("day") <= 15)
    return G.dedupe_events(x.flat, stored).select("event_id", "ts")


@query()
def ingest_batch(x: Lab) -> DataFrame:
    return G.ingest_batch(x.messages).counters


@query()
def flatten_events(x: Lab) -> DataFrame:
    return x.flat.select(
        "event_id", "ts", "ingested_at", "event_category", "event_action", "event_outcome", "event_reason",
        "user_id", "user_name", "user_domain", "source_ip", "source_port", "source_country", "source_city",
        "service_name", "service_environment", "user_agent", "labels", "offset",
    )


@query()
def quarantine_bad_values(x: Lab) -> DataFrame:
    return x.validated.filter("failure_type = 'PERSIST_ERROR'").select("key", "offset", "failure_reason")


@query()
def schema_conformance(x: Lab) -> DataFrame:
    return G.schema_conformance(x.messages)


@query()
def partition_by_day(x: Lab) -> DataFrame:
    """Rows per day partition and in the default partition, as written in one commit and read back; the first days
    and the newest are not among the expected ones."""
    newest, path = _newest_day(x), f"{_scratch(x.spark)}/by-day"
    L.write_days(x.ev, path, expected=(newest - dt.timedelta(days=27), newest - dt.timedelta(days=3)))
    counts = L.read_archive(x.spark, path).groupBy("year", "month", "day").agg(F.count("*").alias("events"))
    rest = L.read_default(x.spark, path).agg(F.count("*").alias("events"))
    label = F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    return counts.select(label.alias("partition"), "events").unionByName(
        rest.select(F.lit(L.DEFAULT_PARTITION).alias("partition"), "events")
    )


@query()
def cloud_audit_ingest(x: Lab) -> DataFrame:
    return C.cloud_ingest_report(x.cloud_records)


@query()
def cloud_ingest(x: Lab) -> DataFrame:
    """Cloud events through the ingest chain, every delivery twice: what is stored and what is turned away."""
    done = G.ingest_batch(C.cloud_messages(x.cloud.unionByName(x.cloud)))
    stored = done.good.groupBy("event_action").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))
    totals = done.counters.select(F.lit("(duplicates)").alias("event_action"), F.col("duplicates").alias("events"), F.col("rejected").alias("ids"))
    return stored.unionByName(totals)


@query()
def cloud_audit_events(x: Lab) -> DataFrame:
    return x.cloud.drop("raw", "ingested_at", "source_country", "source_city", "source_port")


@query()
def archive_write(x: Lab) -> DataFrame:
    """Rows per action and day as they come back from the written archive."""
    return x.archive.groupBy("year", "month", "day", "event_action").agg(
        F.count("*").alias("events"), F.count("labels").alias("labelled")
    )


@query()
def archive_scan(x: Lab) -> DataFrame:
    """One day of the archive, through the partition columns."""
    day = _newest_day(x) - dt.timedelta(days=1)
    return x.archive.filter(L.day_between(day, day)).select(
        "event_id", "ts", "event_action", "user_id", "source_ip", "day"
    )


@query()
def archive_verify(x: Lab) -> DataFrame:
    return L.verify_archive(x.ev, x.archive)


@query()
def publish_baselines(x: Lab) -> DataFrame:
    value = F.from_json("value", "user_id string, total_events bigint, countries array<string>, active_hours array<int>, primary_country string")
    return B.publish_baselines(x.baseline).select("key", value.alias("v")).select(
        "key", "v.total_events", "v.countries", "v.active_hours", "v.primary_country"
    )


@query()
def ingest_counters(x: Lab) -> DataFrame:
    kept = G.dedupe_events(x.flat)
    extra = x.flat.join(kept.select("event_id", "ts", "offset"), ["event_id", "ts", "offset"], "left_anti")
    return Q.ingest_counters(kept, x.dead, extra)


# --- predicates and listings -----------------------------------------------------------------


@query()
def rule_match(x: Lab) -> DataFrame:
    """How many events each rule matches, including the any-of conditions."""
    return W.rule_hits(x.ev, WEEKLY).groupBy("rule_id").agg(
        F.count("*").alias("events"), F.countDistinct("entity_id").alias("entities")
    )


@query()
def rule_match_any(x: Lab) -> DataFrame:
    rule = next(r for r in WEEKLY if r.id == "suspicious-password-change")
    return x.ev.filter(compile_match(rule)).select("event_id", "user_id", "user_agent")


@query()
def field_resolver(x: Lab) -> DataFrame:
    """Non-null values per supported path."""
    from secstream.functions.fields import FIELD_COLUMNS

    counts = x.ev.agg(*[F.count(field(p)).alias(p) for p in FIELD_COLUMNS])
    rows = [F.struct(F.lit(p).alias("path"), F.col(f"`{p}`").alias("present")) for p in FIELD_COLUMNS]
    return counts.select(F.inline(F.array(*rows)))


@query()
def lookback_filter(x: Lab) -> DataFrame:
    return x.ev.filter(S.after("ts", x.now, "7 days")).groupBy("event_action").agg(F.count("*").alias("events"))


@query()
def recent_events(x: Lab) -> DataFrame:
    return H.recent_events(x.ev, x.now, 50).select("event_id", "ts", "user_id", "event_action", "event_outcome", "source_ip")


@query()
def entity_pivot(x: Lab) -> DataFrame:
    return H.entity_pivot(x.ev, "203.0.113.85").select("event_id", "ts", "user_id", "source_ip")


@query()
def entity_pivot_cidr(x: Lab) -> DataFrame:
    return H.entity_pivot(x.ev, "10.16.0.0/13").select("event_id", "ts", "user_id", "source_ip")


@query()
def trail_tampering(x: Lab) -> DataFrame:
    return H.trail_tampering(x.cloud)


@query()
def root_usage(x: Lab) -> DataFrame:
    return H.root_usage(x.cloud_records)


@query()
def cloud_events(x: Lab) -> DataFrame:
    return H.cloud_events(x.cloud).select("event_id", "ts", "event_action", "user_id")


@query()
def labelled_events(x: Lab) -> DataFrame:
    with_scenario = H.labelled_events(x.ev, "scenario").agg(F.count("*")).scalar()
    return H.labelled_events(x.ev, None).groupBy("event_outcome").agg(F.count("*").alias("events")).withColumn("with_scenario", with_scenario)


# --- scalar functions ------------------------------------------------------------------------


@query()
def date_time_functions(x: Lab) -> DataFrame:
    return x.ev.groupBy(
        F.date_trunc("hour", "ts").alias("hour_start"), F.hour("ts").alias("hour"), S.floor_time(F.col("ts"), "3 days").alias("window_start")
    ).agg(F.count("*").alias("events"), F.sum(S.gap_micros(F.col("ingested_at"), F.col("ts"))).alias("lag_us"))


@query()
def string_functions(x: Lab) -> DataFrame:
    docs = x.spark.read.parquet(f"{x.sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length(S.shorten(F.col("text"), 500)).alias("shown"), F.concat_ws("|", "lang", "source").alias("joined"))


@query()
def json_functions(x: Lab) -> DataFrame:
    action = F.get_json_object("raw", "$.event.action")
    geo = F.get_json_object("raw", "$.source.geo.country_iso_code")
    reason = F.json_object_keys(F.get_json_object("raw", "$.event"))
    return x.ev.groupBy(action.alias("action"), geo.alias("country"), F.array_contains(reason, "reason").alias("has_reason")).agg(
        F.count("*").alias("events")
    )


@query()
def array_functions(x: Lab) -> DataFrame:
    return x.history.select(
        "user_id", "countries", F.size("active_hours").alias("hours"), F.array_contains("countries", "RU").alias("ru"),
        S.listed(F.col("countries"), F.lit("SG")).alias("sg_known"),
    )


@query()
def ip_helpers(x: Lab) -> DataFrame:
    return x.ev.select("source_ip").distinct().select(
        "source_ip", S.network_of(F.col("source_ip")).alias("network"), S.is_private(F.col("source_ip")).alias("private"),
        S.network_changed(F.col("source_ip"), F.lit("203.0.113.1")).alias("moved"),
        S.ipv4_number(F.col("source_ip")).alias("number"), S.is_address(F.col("source_ip")).alias("valid"),
    )


@query()
def numeric_functions(x: Lab) -> DataFrame:
    """Safe ratio, F1 and volume ratio per account."""
    fails = F.count_if(F.col("event_outcome") == "failure")
    logins = F.count_if(F.col("event_action") == "user-login")
    keys = F.count_if((F.col("event_action") == "role-change"))
    return x.ev.groupBy("user_id").agg(
        F.round(S.ratio(fails, keys), 6).alias("per_grant"),
        F.round(S.f1(S.ratio(fails, F.count("*")), S.ratio(logins, F.count("*"))), 6).alias("f1"),
        F.round(S.volume_ratio(F.count("*"), logins / F.lit(31.0)), 6).alias("volume_ratio"),
    )


@query()
def baseline_predicates(x: Lab) -> DataFrame:
    """Known country and agent, active hour and dormancy of every event against its baseline."""
    known = x.history.select("user_id", "countries", "user_agents", "active_hours", "dormant_days")
    rows = x.ev.select("user_id", "ts", "source_country", F.col("user_agent").alias("agent")).join(known, "user_id")
    return rows.groupBy("user_id").agg(
        F.count_if(S.listed(F.col("countries"), F.col("source_country"))).alias("known_country"),
        F.count_if(S.listed(F.col("user_agents"), F.col("agent"))).alias("known_agent"),
        F.count_if(S.listed(F.col("active_hours"), F.hour("ts"))).alias("active_hour"),
        F.count_if(F.col("dormant_days") >= 1.0).alias("dormant"),
    )


@query()
def severity_algebra(x: Lab) -> DataFrame:
    s = F.col("severity")
    return x.alerts.groupBy("severity", "entity_type").agg(
        F.first(S.severity_rank(s)).alias("rank"), F.first(S.severity_weight(s)).alias("weight"),
        F.bool_or(S.at_least(s, "medium")).alias("at_least_medium"), F.count("*").alias("alerts"),
    )


@query()
def risk_decay(x: Lab) -> DataFrame:
    """What is left at the newest event of a score worth ``lag`` points set at each event."""
    left = S.decayed(S.lag_seconds() * 40, S.gap_micros(x.now, F.col("ts")), 21600)
    return x.ev.select("event_id", F.round(left, 6).alias("left"))


@query()
def dedupe_key(x: Lab) -> DataFrame:
    return x.alerts.groupBy(S.dedupe_key().alias("dedupe_key")).agg(F.count("*").alias("firings"))


@query()
def interval_overlap(x: Lab) -> DataFrame:
    """Alert windows that are within a day of the account's last event."""
    spans = x.ev.groupBy(F.col("user_id").alias("entity_id")).agg(F.max("ts").alias("b1"))
    near = S.overlaps(F.col("window_start"), F.col("window_end"), F.col("b1"), F.col("b1"), "1 day")
    return x.alerts.join(spans, "entity_id").groupBy("rule_id").agg(F.count_if(near).alias("near"), F.count("*").alias("alerts"))


# --- aggregations ----------------------------------------------------------------------------


@query()
def ingest_health(x: Lab) -> DataFrame:
    return H.ingest_health(x.ev, x.now, MONTH)


@query()
def events_per_minute(x: Lab) -> DataFrame:
    return H.events_per_minute(x.ev, x.now, MONTH)


@query()
def duplicate_check(x: Lab) -> DataFrame:
    """Over the raw arrivals, where redelivered messages show."""
    return H.duplicate_check(x.flat)


@query()
def login_failure_rate(x: Lab) -> DataFrame:
    return H.login_failure_rate(x.ev, x.now, MONTH).withColumn("failure_rate", F.round("failure_rate", 6))


@query()
def user_activity(x: Lab) -> DataFrame:
    return H.user_activity(x.ev, x.now, MONTH)


@query()
def user_countries(x: Lab) -> DataFrame:
    return H.user_countries(x.ev, x.now, MONTH)


@query()
def brute_force_hunt(x: Lab) -> DataFrame:
    return H.brute_force_hunt(x.ev, x.now, 31 * 1440, 10)


@query()
def noisy_sources(x: Lab) -> DataFrame:
    return H.noisy_sources(x.ev, x.now, 31 * 1440, 10)


@query()
def attack_inventory(x: Lab) -> DataFrame:
    return H.attack_inventory(x.ev)


@query()
def user_baseline(x: Lab) -> DataFrame:
    return x.baseline


@query()
def modal_values(x: Lab) -> DataFrame:
    """Primary country and peak hour."""
    return x.baseline.select("user_id", "primary_country", "peak_hour")


@query()
def baseline_distribution(x: Lab) -> DataFrame:
    return B.baseline_distribution(x.baseline)


@query()
def baseline_outliers(x: Lab) -> DataFrame:
    return B.baseline_outliers(x.baseline)


@query()
def baseline_publish_stats(x: Lab) -> DataFrame:
    return B.baseline_publish_stats(x.baseline)


@query()
def archive_actions(x: Lab) -> DataFrame:
    return H.archive_actions(x.archive)


@query()
def archive_sources(x: Lab) -> DataFrame:
    return H.archive_sources(x.archive)


@query()
def archive_attacks(x: Lab) -> DataFrame:
    return H.archive_attacks(x.archive)


@query()
def storage_stats(x: Lab) -> DataFrame:
    return L.storage_stats(x.archive)


@query()
def tier_comparison(x: Lab) -> DataFrame:
    source = x.spark.read.parquet(f"{x.sf_dir}/events.parquet")
    hot = source.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return L.compare_tiers(hot, x.archive)


@query()
def quality_checks(x: Lab) -> DataFrame:
    newest = _newest_day(x)
    return Q.quality_checks(x.ev, x.dead, L.split_by_range(x.ev, newest - dt.timedelta(days=24), newest)[1], x.now)


@query()
def quality_latest(x: Lab) -> DataFrame:
    """A check history with one entry per day and check, reduced to the newest."""
    days = x.ev.groupBy(F.date_trunc("day", "ts").alias("checked_at")).agg(
        F.count("*").alias("rows"), F.countDistinct("user_id").alias("users")
    )
    long = days.select(
        "checked_at",
        F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("double").alias("observed")) for n in ("rows", "users")])),
    )
    return Q.quality_latest(long)


@query()
def window_state(x: Lab) -> DataFrame:
    return W.window_state(x.ev, WEEKLY).withColumn("window_us", F.timestamp_micros("window_us"))


@query()
def window_evidence(x: Lab) -> DataFrame:
    """Samples and context of all windows, also of those that never fired."""
    rows = W.window_evidence(x.ev.drop("labels", "raw"), WEEKLY)
    return rows.select("rule_id", "entity_id", F.timestamp_micros("window_us").alias("window_us"), "events_in_window", "sample_event_ids", F.col("context")["source.ip"].alias("source_ips"))


@query()
def pipeline_state(x: Lab) -> DataFrame:
    return Q.pipeline_state(x.ev, latest(x.ev, "ingested_at"))


def _samples(x: Lab) -> DataFrame:
    """Per hour of a day the rows stored so far that day; the day sets the offered rate."""
    hours = x.ev.groupBy(F.to_date("ingested_at").alias("d"), F.hour("ingested_at").alias("h")).agg(
        F.count("*").alias("n"), F.max(S.lag_seconds()).alias("max_lag_s"), F.max("ingested_at").alias("at")
    )
    total = F.sum("n").over(Window.partitionBy("d").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    return hours.select((F.dayofmonth("d") * 0.0005).alias("offered_rate"), "at", total.alias("ingested"), "max_lag_s")


@query()
def keep_up_report(x: Lab) -> DataFrame:
    return Q.keep_up_report(_samples(x))


@query()
def breaking_point(x: Lab) -> DataFrame:
    return Q.breaking_point(Q.keep_up_report(_samples(x)))


@query()
def pipeline_health(x: Lab) -> DataFrame:
    return Q.pipeline_health(x.ev, x.dead, quiet_minutes=30, dlq_minutes=15, max_lag=25.0)


@query()
def alert_rates(x: Lab) -> DataFrame:
    return A.alert_rates(x.alerts)


@query()
def alert_share(x: Lab) -> DataFrame:
    return A.alert_share(x.alerts, x.now, "7 days")


@query()
def response_counters(x: Lab) -> DataFrame:
    return A.response_counters(x.response.positions, x.response.incidents, x.now, "7 days")


@query()
def attack_coverage(x: Lab) -> DataFrame:
    return A.attack_coverage(x.alerts, WEEKLY)


# --- window functions and joins --------------------------------------------------------------


@query()
def new_country_logins(x: Lab) -> DataFrame:
    return H.new_country_logins(x.ev, x.now, "12 hours", MONTH, None)


@query()
def threshold_crossing(x: Lab) -> DataFrame:
    return W.threshold_crossings(x.ev, WEEKLY).withColumn("window_us", F.timestamp_micros("window_us"))


@query()
def session_fingerprint(x: Lab) -> DataFrame:
    """The login or token that each event's session was opened with."""
    from secstream.functions.ordered import running_before

    opens = E.is_auth() & E.succeeded()
    opened = F.when(opens, F.struct("event_id", "source_ip"))
    rows = running_before(x.ev.select("user_id", "ts", "event_id", "event_action", "event_outcome", "source_ip"), ["user_id"], "ts", ["event_id"], {"session": ("last", opened)})
    return rows.select("event_id", "user_id", F.col("session.event_id").alias("session_event"), F.col("session.source_ip").alias("session_ip"))


@query()
def late_event_audit(x: Lab) -> DataFrame:
    """Every twentieth port stands for a collector that was cut off for two days."""
    delayed = F.when(F.col("source_port") % 20 == 3, F.col("ingested_at") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ingested_at"))
    return H.late_events(x.ev.withColumn("ingested_at", delayed), "user_id", "1 second")


@query()
def brute_force_success(x: Lab) -> DataFrame:
    return H.brute_force_success(x.ev, x.now, 10, "12 hours", MONTH)


@query()
def baseline_enrich(x: Lab) -> DataFrame:
    known = x.history.select("user_id", "total_events", "primary_country")
    return x.ev.select("event_id", "user_id", "source_country").join(known, "user_id")


@query()
def outstanding_action_filter(x: Lab) -> DataFrame:
    """Proposals that remain when half of the accounts already have an outstanding lockout."""
    taken = R.propose_actions(*x.attached).filter("action = 'disable_account'").select(
        "action", "target_type", "target_id",
        F.when(F.ascii(F.substring("target_id", 7, 1)) % 2 == 0, "executed").otherwise("rejected").alias("status"),
    )
    return R.propose_actions(*x.attached, taken).select("action", "target_type", "target_id", "requires_approval")


@query()
def incident_detail(x: Lab) -> DataFrame:
    log = x.transitions[1]
    notes = log.filter("accepted").select("incident_id", "at", F.col("actor").alias("author"), "note")
    return I.incident_detail(x.response.incidents, x.triaged, notes, x.response.actions)


@query()
def incident_list(x: Lab) -> DataFrame:
    return I.incident_list(x.response.incidents, x.response.stored, limit=200).select("incident_id", "severity", "updated_at", "alert_count")


@query()
def undetected_runs(x: Lab) -> DataFrame:
    return V.undetected_runs(x.runs)


@query()
def top_risk(x: Lab) -> DataFrame:
    return K.top_risk(x.response.risk, x.now, 20)


# --- detections ------------------------------------------------------------------------------


def _rule_query(rule: Rule):
    def run(x: Lab) -> DataFrame:
        columns = ["alert_id", "detected_at", "window_start", "window_end", "rule_id", "severity", "technique", "entity_type", "entity_id", "observed", "threshold"]
        return W.threshold_alerts(x.ev.drop("labels", "raw"), [rule]).select(*columns)

    return run


for _rule in WEEKLY:
    query(_rule.id.replace("aws-", "cloud-").replace("-", "_"))(_rule_query(_rule))


@query()
def threshold_evidence(x: Lab) -> DataFrame:
    return W.threshold_alerts(x.ev.drop("labels", "raw"), WEEKLY).select(
        "alert_id",
        F.col("context")["events_in_window"].alias("events_in_window"),
        F.col("context")["source.ip"].alias("source_ips"),
        F.col("context")["distinct_count"].alias("distinct_count"),
        F.col("context")["distinct_sample"].alias("distinct_sample"),
        F.col("context")["last_seen"].alias("last_seen"),
        "sample_event_ids",
    )


@query()
def impossible_travel(x: Lab) -> DataFrame:
    return E.impossible_travel(x.ev.drop("labels", "raw"), "12 hours").drop("context", "sample_event_ids")


@query()
def session_hijack(x: Lab) -> DataFrame:
    return E.session_hijack(x.ev.drop("labels", "raw")).select(
        "*", F.col("context")["network_class_change"].alias("network_class_change"), F.col("context")["observed_user_agent"].alias("observed_user_agent")
    ).drop("context", "sample_event_ids")


@query()
def baseline_deviation(x: Lab) -> DataFrame:
    return E.baseline_deviation(x.ev.drop("labels", "raw"), x.history).select(
        "alert_id", "detected_at", "entity_id", "severity", "observed", F.col("context")["deviations"].alias("deviations")
    )


@query()
def alert_union(x: Lab) -> DataFrame:
    return x.alerts.drop("context", "sample_event_ids", "rule_name")


# --- alerts, risk, incidents, response, scoring ----------------------------------------------


@query()
def alert_islands(x: Lab) -> DataFrame:
    return x.response.positions.select("alert_id", "stored_id", "occurrence")


@query()
def fold_alerts(x: Lab) -> DataFrame:
    return x.response.stored.drop("context", "sample_event_ids", "incident_id", "rule_name")


@query()
def alert_list(x: Lab) -> DataFrame:
    return A.alert_list(x.triaged, 200, severity="high").select("id", "rule_id", "last_detected_at", "occurrences", "triage")


@query()
def rule_stats(x: Lab) -> DataFrame:
    return A.rule_stats(x.triaged)


@query()
def triage(x: Lab) -> DataFrame:
    return x.triaged.select("id", "triage", "triaged_at", "triaged_by")


@query()
def firing_scores(x: Lab) -> DataFrame:
    return x.response.scored.select("alert_id", "occurrence", F.round("score", 6).alias("score"))


@query()
def risk_scores(x: Lab) -> DataFrame:
    return x.response.risk.withColumn("score", F.round("score", 6)).withColumn("peak_score", F.round("peak_score", 6))


@query()
def open_incidents(x: Lab) -> DataFrame:
    return x.response.incidents.withColumn("risk_score", F.round("risk_score", 6)).withColumn("opening_risk", F.round("opening_risk", 6))


@query()
def incident_transitions(x: Lab) -> DataFrame:
    return x.transitions[1].select("incident_id", "at", "to", "found", "left", "accepted")


@query()
def incident_states(x: Lab) -> DataFrame:
    return x.transitions[0].select("incident_id", "status", "updated_at", "closed_at", "resolution")


@query()
def propose_actions(x: Lab) -> DataFrame:
    return R.propose_actions(*x.attached)


@query()
def action_lifecycle(x: Lab) -> DataFrame:
    return x.lifecycle[0].select("action_id", "status", "approved_by", "reverted_by", "error")


@query()
def action_list(x: Lab) -> DataFrame:
    return R.action_list(x.lifecycle[0], limit=50).select("action_id", "proposed_at", "status", "outcome")


@query()
def audit_trail(x: Lab) -> DataFrame:
    return x.trail.groupBy("actor", "action", "subject_type").agg(F.count("*").alias("entries"), F.max("at").alias("last_at"))


@query()
def audit_recent(x: Lab) -> DataFrame:
    return R.audit_recent(x.trail).select("at", "subject_type", "action")


@query()
def audit_subject(x: Lab) -> DataFrame:
    return R.audit_subject(x.trail, "user", "u-00001").select("at", "actor", "action", "detail")


@query()
def attack_ground_truth(x: Lab) -> DataFrame:
    return V.attack_ground_truth(x.ev, x.now, WINDOW, TOLERANCE)


@query()
def score_match(x: Lab) -> DataFrame:
    return x.matched.select("id", "rule_id", "matched")


@query()
def score_rules(x: Lab) -> DataFrame:
    return V.score_rules(x.matched).withColumn("precision", F.round("precision", 6))


@query()
def score_scenarios(x: Lab) -> DataFrame:
    return V.score_scenarios(x.runs).withColumn("recall", F.round("recall", 6))


@query()
def score_overall(x: Lab) -> DataFrame:
    rows = V.score_overall(x.matched, x.runs)
    return rows.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in rows.columns])


@query()
def score_history(x: Lab) -> DataFrame:
    rows = V.score_history_rows(V.score_rules(x.matched), V.score_scenarios(x.runs), x.now, WINDOW)
    path = f"{_scratch(x.spark)}/scores"
    for _ in range(2):  # the second time is the same run
        V.append_score_history(rows, path)
    back = V.read_score_history(x.spark, path)
    return back.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in back.columns])


# --- the standard pack, on bursts -------------------------------------------------------------


def _standard(rule: Rule):
    columns = ["alert_id", "detected_at", "rule_id", "severity", "entity_type", "entity_id", "observed", "threshold", "window_start", "window_end"]
    return lambda x: x.standard_alerts.filter(F.col("rule_id") == rule.id).select(*columns)


for _rule in STANDARD:
    query(f"standard_{_rule.id.replace('-', '_')}")(_standard(_rule))


# --- carried over between runs ---------------------------------------------------------------

_INCIDENTS = (
    "incident_id string, status string, severity string, title string, entity_type string, entity_id string, risk_score double, opened_at timestamp, "
    "updated_at timestamp, closed_at timestamp, resolution string, opening_rule string, opening_risk double"
)
_CARRIED_ALERTS = (
    "id string, dedupe_key string, first_detected_at timestamp, last_detected_at timestamp, occurrences bigint, rule_id string, severity string, "
    "technique string, entity_type string, entity_id string, observed bigint, threshold bigint, window_start timestamp, window_end timestamp, active boolean"
)
_RISK = "entity_type string, entity_id string, score double, peak_score double, updated_at timestamp, peaked_at timestamp"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query()
def incident_history(x: Lab) -> DataFrame:
    """All incidents of each entity: after a terminal move the next attached firing opens the next one."""
    return _rounded(I.incident_history(x.response.attached, x.entity_requests)[0], "risk_score", "opening_risk")


@query()
def incident_requests(x: Lab) -> DataFrame:
    """What became of each request on an entity: the incident it met, the states before and after."""
    log = I.incident_history(x.response.attached, x.entity_requests)[1]
    return log.select("incident_id", "entity_id", "at", "seq", "to", "found", "left", "accepted")


@query()
def carried_alerts(x: Lab) -> DataFrame:
    """Stored alerts after two runs; a row that the first run left open goes on in the second."""
    return x.carried.stored.read(T.StructType.fromDDL(_CARRIED_ALERTS))


@query()
def carried_risk(x: Lab) -> DataFrame:
    return _rounded(x.carried.risk.read(T.StructType.fromDDL(_RISK)), "score", "peak_score")


@query()
def carried_incidents(x: Lab) -> DataFrame:
    return _rounded(x.carried.incidents.read(T.StructType.fromDDL(_INCIDENTS)), "risk_score", "opening_risk")


# --- lake ------------------------------------------------------------------------------------


@query()
def retention_plan(x: Lab) -> DataFrame:
    """Days past the retention, from the names of the archive's folders alone."""
    due = L.apply_retention(x.spark, x.archive_path, _newest_day(x), 20, dry_run=True)
    return x.spark.createDataFrame([(d.year, d.month, d.day) for d in due], "year int, month int, day int")


@query()
def partition_report(x: Lab) -> DataFrame:
    """Rows per day (bytes depend on the writer and are checked in the tests)."""
    return L.partition_report(x.archive).select("year", "month", "day", "rows")


@query()
def small_files_report(x: Lab) -> DataFrame:
    return L.small_files_report(x.archive)


@query()
def pruning_report(x: Lab) -> DataFrame:
    return L.pruning_report(x.archive, _newest_day(x) - dt.timedelta(days=1)).select("variant", "rows")


@query()
def compact_day(x: Lab) -> DataFrame:
    """One day split over many files, compacted and read back."""
    day = _newest_day(x) - dt.timedelta(days=1)
    path = f"{_scratch(x.spark)}/compact"
    split = F.to_date("ts") == F.lit(day)
    L.write_days(x.ev.filter(~split), path)
    L.write_days(x.ev.filter(split), path, rows_per_file=50)
    L.compact_day(x.spark, path, day)
    back = L.read_archive(x.spark, path)
    return back.groupBy("year", "month", "day").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))


@query()
def daily_maintenance(x: Lab) -> DataFrame:
    """The daily job for the day before the newest: gate at its noon with the dead letters of the hour
    before and the events outside the last forty days, archive, verify, compact; returns the archived rows and
    whether the gate blocked the job."""
    day, path = _newest_day(x) - dt.timedelta(days=1), f"{_scratch(x.spark)}/daily"
    noon = F.lit(dt.datetime.combine(day, dt.time(12), dt.timezone.utc))
    stray = L.split_by_range(x.ev, day - dt.timedelta(days=40), day + dt.timedelta(days=1))[1]
    checks = Q.quality_checks(x.ev, x.dead, stray, noon)
    try:
        L.daily_maintenance(x.ev, checks, day, path)
        archived, blocked = L.read_archive(x.spark, path), False
    except L.QualityGateFailed:
        archived, blocked = L.to_archive(x.ev.filter("false")), True
    rows = archived.groupBy("event_action").agg(F.count("*").alias("events"))
    names = x.ev.filter(F.to_date("ts") == F.lit(day)).select("event_action").distinct()
    return names.join(rows, "event_action", "left").select("event_action", F.coalesce("events", F.lit(0)).alias("events"), F.lit(blocked).alias("blocked"))


def _newest_day(x: Lab) -> dt.date:
    return x.ev.agg(F.to_date(F.max("ts"))).first()[0]


@query()
def default_partition(x: Lab) -> DataFrame:
    """Events of which some are dated three years ahead: where they land, whether they stop the daily job, and what
    is left of them after retention has dropped the days before the last ten."""
    newest, path = _newest_day(x), f"{_scratch(x.spark)}/stray"
    ahead = x.ev.filter("source_port % 50 = 7").withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 YEARS"))
    expected = (newest - dt.timedelta(days=40), newest)
    for _ in range(2):  # a repeated run changes nothing
        L.write_days(x.ev.unionByName(ahead), path, expected=expected, run="load")
    # without dead letters: what stops the job can only be the default partition
    checks = Q.quality_checks(x.ev, x.dead.filter("false"), L.read_default(x.spark, path), x.now)
    try:
        L.daily_maintenance(x.ev, checks, newest, f"{path}-job")
        blocked = False
    except L.QualityGateFailed:
        blocked = True
    L.apply_retention(x.spark, path, newest, 10, dry_run=False)
    days = L.read_archive(x.spark, path).select(F.to_date("ts").cast("string").alias("partition"))
    stray = L.read_default(x.spark, path).select(F.lit(L.DEFAULT_PARTITION).alias("partition"))
    return days.union(stray).groupBy("partition").agg(F.count("*").alias("events")).withColumn("blocked", F.lit(blocked))


@query()
def daily_retention(x: Lab) -> DataFrame:
    """Hot and archived rows per day after the daily job has dropped hot days for good.

    Every fifth day of the month was never archived: its hot rows must survive. Nothing archived goes.
    """
    day = _newest_day(x) - dt.timedelta(days=1)
    hot, path = f"{_scratch(x.spark)}/hot", f"{_scratch(x.spark)}/hot-archive"
    L.with_day(x.ev.select(*schema.FLAT_COLUMNS)).write.partitionBy(*schema.DAY_PARTS).parquet(hot)
    L.write_days(x.ev.filter((F.dayofmonth("ts") % 5 != 0) & (F.to_date("ts") < F.lit(day))), path)
    passing = x.spark.range(1).select(F.lit("none").alias("check_name"), F.lit("correctness").alias("category"), F.lit(True).alias("passed"))
    L.daily_maintenance(x.ev, passing, day, path, hot_path=hot, retain_days=10, dry_run=False)

    def per_day(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.to_date("ts").alias("on_day")).agg(F.count("*").alias(name))

    left = x.spark.read.schema(schema.FLAT_EVENT).parquet(hot)
    both = per_day(left, "hot_rows").join(per_day(L.read_archive(x.spark, path), "archive_rows"), "on_day", "full")
    return both.select("on_day", F.coalesce("hot_rows", F.lit(0)).alias("hot_rows"), F.coalesce("archive_rows", F.lit(0)).alias("archive_rows"))


@query()
def snapshot_append(x: Lab) -> DataFrame:
    return x.snapshots.groupBy("load_id", "event_action").agg(F.count("*").alias("events"))


@query()
def snapshot_as_of(x: Lab) -> DataFrame:
    return L.snapshot_as_of(x.snapshots, 2).groupBy("event_action").agg(F.count("*").alias("events"), F.max("ts").alias("newest"))


@query()
def snapshot_history(x: Lab) -> DataFrame:
    return L.snapshot_history(x.snapshots)


@query()
def schema_evolution(x: Lab) -> DataFrame:
    """Old loads lack a column that the newest load has."""
    path = f"{_scratch(x.spark)}/evolved"
    rows = x.ev.select("event_id", "event_action", F.dayofmonth("ts").alias("d"), "source_ip")
    old = rows.filter("d <= 20").select("event_id", "event_action")
    new = rows.filter("d > 20").select("event_id", "event_action", S.network_of(F.col("source_ip")).alias("enrichment_network"))
    old.write.parquet(path)
    new.write.mode("append").parquet(path)
    back = L.read_evolved(x.spark, path, new.schema)
    return back.groupBy("event_action", F.col("enrichment_network").isNull().alias("is_old")).agg(F.count("*").alias("events"))


# --- streams: run over the landed tables until they are drained, then read the result table ----


#: Rows of a landed file at most, nearly: a stretch takes more files where it has more rows.
ROWS_A_FILE = 250_000


class Landed(NamedTuple):
    path: str
    per_stretch: int


def _landed(x: Lab, rows: DataFrame, order: str, name: str, stretches: int = 4) -> Landed:
    """Rows as Parquet files in stretches of ``order``; files of later stretches are newer.

    All stretches have the same number of files, which grows with the rows: a stream that takes so many files a
    trigger has one stretch in each micro-batch. A stretch with too few rows for its files goes with the next one.
    """
    path = f"{_scratch(x.spark)}/{name}"
    low, high = rows.agg(F.unix_micros(F.min(order)), F.unix_micros(F.max(order))).first()
    part = F.least(F.floor((F.unix_micros(order) - low) * stretches / F.lit(high - low + 1)), F.lit(stretches - 1))
    cut = materialise(rows.withColumn("_part", part), f"{name}-cut")
    sizes = {r["_part"]: r["count"] for r in cut.groupBy("_part").count().collect()}  # a row a stretch
    files = max(2, math.ceil(max(sizes.values()) / ROWS_A_FILE))
    groups, waiting = [], []
    for k in sorted(sizes):
        waiting.append(k)
        if sum(sizes[w] for w in waiting) >= 20 * files:
            groups, waiting = [*groups, waiting], []
    if waiting:
        groups = [*groups[:-1], [*(groups[-1] if groups else []), *waiting]]
    for group in groups:
        cut.filter(F.col("_part").isin(group)).drop("_part").repartition(files, F.rand(len(group))).write.mode("append").parquet(path)
    return Landed(path, files)


def _drained(x: Lab, stream: DataFrame, name: str) -> DataFrame:
    table = f"{_scratch(x.spark)}/{name}"
    sources.alert_sink(stream, table, f"{table}-checkpoint").awaitTermination()
    return x.spark.read.parquet(table).drop("batch")


def _event_stream(x: Lab) -> DataFrame:
    return sources.file_events(x.spark, *_landed(x, x.ev.select(*schema.FLAT_COLUMNS), "ts", "stream-events"))


@query()
def stream_ingest_events(x: Lab) -> DataFrame:
    """Stored events and dead letters after the messages went through the ingest stream."""
    landing = _landed(x, x.messages, "arrived_at", "stream-messages")
    events, dead = (f"{_scratch(x.spark)}/{n}" for n in ("stream-stored", "stream-dead"))
    I_STREAM.stream_ingest(sources.file_messages(x.spark, *landing), events, dead, f"{events}-checkpoint").awaitTermination()
    stored = I_STREAM.stored_events(x.spark, events).groupBy("event_action").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    letters = x.spark.read.parquet(dead).groupBy("failure_type").agg(F.count("*").alias("n"), F.countDistinct("source_offset").alias("ids"))
    return stored.select(F.lit("event").alias("kind"), F.col("event_action").alias("name"), "n", "ids").unionByName(
        letters.select(F.lit("dead letter").alias("kind"), F.col("failure_type").alias("name"), "n", "ids")
    )


@query()
def stream_event_times(x: Lab) -> DataFrame:
    """The same from a stream, whose micro-batches hand the stream time on."""
    landing = _landed(x, x.messages.withColumn("place", F.timestamp_micros("offset")), "place", "stream-places")
    times, state = (f"{_scratch(x.spark)}/{n}" for n in ("stream-times", "stream-times-state"))
    I_STREAM.stream_times(sources.file_messages(x.spark, *landing), times, state, f"{times}-checkpoint").awaitTermination()
    return x.spark.read.parquet(times).select("partition", "offset", "time", "time_from")


@query()
def stream_dedupe_events(x: Lab) -> DataFrame:
    """Each event three times, one of them an hour later under the same id: two are left of each."""
    rows = x.ev.select(*schema.FLAT_COLUMNS)
    later = rows.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    stream = sources.file_events(x.spark, *_landed(x, rows.union(rows).union(later), "ts", "stream-copies", 2))
    return _drained(x, I_STREAM.stream_dedupe(stream, "40 days"), "stream-once").groupBy("event_id").agg(F.count("*").alias("kept"), F.min("ts").alias("first_ts"))


@query()
def stream_threshold_alerts(x: Lab) -> DataFrame:
    """Alerts of all threshold rules from the stream."""
    columns = ["alert_id", "detected_at", "rule_id", "severity", "entity_type", "entity_id", "observed", "threshold"]
    return _drained(x, D_STREAM.stream_threshold(_event_stream(x), WEEKLY), "stream-threshold").select(*columns)


@query()
def stream_travel_alerts(x: Lab) -> DataFrame:
    return _drained(x, D_STREAM.stream_travel(_event_stream(x), "12 hours"), "stream-travel").select("alert_id", "detected_at", "rule_id", "severity", "entity_id", "observed")


@query()
def stream_hijack_alerts(x: Lab) -> DataFrame:
    return _drained(x, D_STREAM.stream_hijack(_event_stream(x)), "stream-hijack").select("alert_id", "detected_at", "rule_id", "severity", "entity_id", "observed")


@query()
def stream_windows(x: Lab) -> DataFrame:
    """Closed windows of a counting and of a distinct rule. The last files also bring the first ten days once more:
    those windows are closed by then, so the late rows must not count."""
    newest, span = x.ev.agg(F.max("ts"), F.min("ts")).first()
    rows = x.ev.select(*schema.FLAT_COLUMNS, F.col("ts").alias("arrives"))
    late = rows.filter(F.col("ts") < F.lit(span) + F.expr("INTERVAL 10 DAYS")).withColumn("arrives", F.lit(newest))
    landing = _landed(x, rows.union(late), "arrives", "stream-late")
    found = None
    for rule in (next(r for r in WEEKLY if not r.distinct), next(r for r in WEEKLY if r.distinct)):
        stream = D_STREAM.stream_window_counts(sources.file_events(x.spark, *landing), rule)
        part = _drained(x, stream, f"stream-{rule.id}").select("rule_id", "entity_id", F.col("start").alias("window_start"), F.col("end").alias("window_end"), "observed")
        found = part if found is None else found.unionByName(part)
    return found


@query()
def stream_deviation_alerts(x: Lab) -> DataFrame:
    """Deviations from a published baseline table that every micro-batch reads anew."""
    base, path = (f"{_scratch(x.spark)}/{n}" for n in ("stream-baseline", "stream-deviation"))
    x.history.write.parquet(base)
    D_STREAM.stream_deviation(_event_stream(x), base, path, f"{path}-checkpoint").awaitTermination()
    return x.spark.read.parquet(path).select("alert_id", "detected_at", "rule_id", "severity", "entity_id", "observed")


def _alert_stream(x: Lab) -> DataFrame:
    landing = _landed(x, x.alerts, "detected_at", "stream-alerts")
    return x.spark.readStream.schema(x.alerts.schema).option("maxFilesPerTrigger", landing.per_stretch).parquet(landing.path)


@query()
def stream_folded_alerts(x: Lab) -> DataFrame:
    """Stored alerts that have been quiet for the suppression window when the stream ends."""
    folded = _drained(x, R_STREAM.stream_fold(_alert_stream(x)), "stream-folded")
    return folded.select("id", "dedupe_key", "rule_id", "first_detected_at", "last_detected_at", "occurrences", "severity", "technique", "observed", "threshold", "window_start", "window_end")


@query()
def stream_risk_scores(x: Lab) -> DataFrame:
    scored = _drained(x, R_STREAM.stream_risk(_alert_stream(x)), "stream-risk")
    return scored.select("alert_id", "detected_at", "occurrence", F.round("score", 6).alias("score"))


@query()
def stream_quality_checks(x: Lab) -> DataFrame:
    """The newest entry of the check history that a stream has kept over the stored events."""
    stored, dead, history = (f"{_scratch(x.spark)}/{n}" for n in ("stream-events-stored", "stream-dead-stored", "stream-checks"))
    sources.write_batch(L.with_day(x.ev.select(*schema.FLAT_COLUMNS)), stored, 0, schema.DAY_PARTS)
    x.dead.write.parquet(dead)
    landed = _landed(x, x.ev.select(*schema.FLAT_COLUMNS), "ingested_at", "stream-checked")
    I_STREAM.stream_quality(sources.file_events(x.spark, *landed), stored, dead, history, f"{history}-checkpoint").awaitTermination()
    return Q.quality_latest(x.spark.read.parquet(history).drop("batch"))


@query()
def stream_batch_metrics(x: Lab) -> DataFrame:
    """Messages received and rejected as the ingest stream's own progress counts them, over all of its micro-batches,
    and whether the percentiles of their times are in order."""
    landing = _landed(x, x.messages, "arrived_at", "stream-counted")
    events, dead = (f"{_scratch(x.spark)}/{n}" for n in ("stream-counted-events", "stream-counted-dead"))
    run = I_STREAM.stream_ingest(sources.file_messages(x.spark, *landing), events, dead, f"{events}-checkpoint")
    run.awaitTermination()
    seen = materialise(I_STREAM.batch_metrics(run), "batch-metrics")
    order = materialise(Q.batch_latency(seen), "batch-latency")
    timed, ordered = F.col("p50") > 0, (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))
    counts = seen.agg(F.sum("received").alias("received"), F.sum("rejected").alias("rejected"))
    return counts.withColumns({n: order.select(c.alias(n)).scalar() for n, c in (("timed", timed), ("ordered", ordered))})


@query()
def cloud_failures(x: Lab) -> DataFrame:
    """Cloud deliveries together with messages that are none, some of them cut: what holds no audit record."""
    astray = x.messages.select("value")
    failed = C.cloud_failures(tables.cloud_deliveries(x.spark, x.sf_dir).select("value").union(astray))
    return failed.groupBy("failure_type", "failure_reason").agg(F.count("*").alias("deliveries"))
