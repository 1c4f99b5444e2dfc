"""Detections over event streams.

``stream_window_counts`` uses native windowed aggregation: partial aggregates on the map side, so
a hot entity costs one row per task, and the alert comes when the window closes.
``stream_threshold`` keeps keyed state and alerts on the very event that crosses the threshold; a
micro-batch's rows of one entity meet in one task, bounded by the trigger size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from secstream.functions.fields import field
from secstream.functions.scalar import micros, seconds
from secstream.operators.rules import Rule, compile_match
from secstream.operators.sequence import account_alert, baseline_deviation, is_auth, succeeded
from secstream.operators.threshold import (
    CONTEXT_VALUES,
    DISTINCT_SHOWN,
    SAMPLES,
    as_alerts,
    rule_hits,
)
from secstream.streaming.sources import reach_package, start, write_batch

# State lifetimes.
LOGIN_TTL = "2 days"
SESSION_TTL = "8 hours"


def stream_window_counts(events: DataFrame, rule: Rule) -> DataFrame:
    """Closed windows of one rule that reached its threshold."""
    hits = events.filter(compile_match(rule) & field(rule.group_by).isNotNull()).select(
        "ts", field(rule.group_by).alias("entity_id"),
        *([field(rule.distinct).alias("counted")] if rule.distinct else []),
    )
    hits = hits.withWatermark("ts", f"{rule.grace_seconds} seconds")
    size = F.window("ts", f"{rule.window_seconds} seconds")
    if rule.distinct:
        per_value = hits.filter(F.col("counted").isNotNull()).groupBy(size, "entity_id", "counted").count()
        again = F.window(F.window_time("window"), f"{rule.window_seconds} seconds")
        counts = per_value.groupBy(again, "entity_id").agg(F.count("*").alias("observed"))
    else:
        counts = hits.groupBy(size, "entity_id").agg(F.count("*").alias("observed"))
    return counts.filter(F.col("observed") >= rule.threshold).select(
        F.lit(rule.id).alias("rule_id"), "entity_id", "window.start", "window.end", "observed"
    )


_FIRED = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("window_us", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("threshold", T.LongType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("samples", T.ArrayType(T.StringType())),
    ]
)


_Fired = Row(*_FIRED.fieldNames())


@dataclass
class _Window:
    """What is known of one (rule, window) of an entity; ``seen`` has the values of each field in order of arrival."""

    rule_id: str
    window_us: int
    closes_us: int
    events: int = 0
    fired: bool = False
    first_us: int | None = None
    last_us: int | None = None
    samples: list[str] = dataclass_field(default_factory=list)
    seen: dict[str, dict[str, None]] = dataclass_field(default_factory=dict)

    def note(self, name: str, item: str | None, limit: int) -> int:
        """Remember a value if there is room; returns how many different ones are known."""
        known = self.seen.setdefault(name, {})
        if item is not None and len(known) < limit:
            known[item] = None
        return len(known)

    def known(self, name: str) -> list[str]:
        return list(self.seen.get(name, ()))

    @property
    def ends_ms(self) -> int:
        return self.closes_us // 1000 + 1

    def stored(self) -> tuple:
        seen = {name: list(items) for name, items in self.seen.items()}
        return (self.rule_id, self.window_us, self.closes_us, self.events, self.fired, self.first_us, self.last_us, self.samples, seen)


class _Crossing(StatefulProcessor):
    """Counts events or distinct values of an entity's (rule, window)s until each fires once.

    All windows of an entity are one state value: every call to the store is a message to another process, so a
    micro-batch reads and writes an entity once, however many rules and windows its events fall into. The distinct
    values that are kept never exceed the threshold, at which the rule fires; a window that has fired keeps none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState(
            "windows",
            "open array<struct<rule_id string, window_us bigint, closes_us bigint, events bigint, fired boolean, first_us bigint, "
            "last_us bigint, samples array<string>, seen map<string, array<string>>>>",
        )

    def _held(self) -> dict[tuple[str, int], _Window]:
        state = self.windows.get()
        held = [_Window(*w[:7], list(w[7]), {n: dict.fromkeys(items) for n, items in w[8].items()}) for w in state[0]] if state else []
        return {(w.rule_id, w.window_us): w for w in held}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        timed, changed = {w.ends_ms for w in held.values()}, False
        for row in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
            if row["closes_us"] <= row["delay_us"] + watermark_us:
                continue
            at = (row["rule_id"], row["window_us"])
            window = held.get(at)
            if window is None:
                window = held[at] = _Window(*at, row["closes_us"])
            if window.fired:
                continue
            changed = True
            window.events += 1
            window.first_us = row["ts_us"] if window.first_us is None else min(window.first_us, row["ts_us"])
            window.last_us = row["ts_us"] if window.last_us is None else max(window.last_us, row["ts_us"])
            if len(window.samples) < SAMPLES:
                window.samples.append(row["event_id"])
            for fact in row["facts"]:
                window.note(fact["name"], fact["item"], CONTEXT_VALUES + 1)
            observed = window.note("", row["counted"], row["threshold"]) if row["distinct_field"] else window.events
            if observed >= row["threshold"]:
                context = self._context(row, window, observed)
                yield _Fired(at[0], key[0], at[1], row["ts_us"], row["event_id"], row["threshold"], context, window.samples)
                window.fired, window.samples, window.seen = True, [], {}
        if changed:
            self.windows.update(([w.stored() for w in held.values()],))
            for ends_ms in {w.ends_ms for w in held.values()} - timed:
                self.handle.registerTimer(ends_ms)

    def _context(self, row, window: _Window, observed: int) -> dict[str, str]:
        context = {"events_in_window": str(window.events), "first_seen": _instant(window.first_us), "last_seen": _instant(window.last_us)}
        if row["distinct_field"]:
            values = window.known("")
            sample = ", ".join(values[:DISTINCT_SHOWN]) + (", …" if len(values) > DISTINCT_SHOWN else "")
            context |= {"distinct_field": row["distinct_field"], "distinct_count": str(observed), "distinct_sample": sample}
        for name in {fact["name"] for fact in row["facts"]}:
            values = window.known(name)
            if values:
                context[name] = ", ".join(values[:CONTEXT_VALUES]) + (", …" if len(values) > CONTEXT_VALUES else "")
        return context

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Windows that closed by this time go, the others stay."""
        left = [w.stored() for w in self._held().values() if w.ends_ms > expiredTimerInfo.getExpiryTimeInMs()]
        if left:
            self.windows.update((left,))
        else:
            self.windows.clear()
        yield from ()

    def close(self) -> None:
        pass


def _instant(at_us: int) -> str:
    return datetime.fromtimestamp(at_us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at_us % 1_000_000:06d}Z"


def stream_threshold(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts of threshold rules, each on the event that crosses the threshold.

    The watermark waits for the longest grace of the pack; a rule with a shorter one refuses late
    events itself. State goes when its window has closed.
    """
    reach_package(events.sparkSession)
    active = {rule.id: rule for rule in rules if rule.enabled}
    delay = max(rule.grace_seconds for rule in active.values())

    def per_rule(value, kind: str):
        choice = F.lit(None)
        for rule in active.values():
            choice = F.when(F.col("rule_id") == rule.id, F.lit(value(rule))).otherwise(choice)
        return choice.cast(kind)

    hits = (
        rule_hits(events.withWatermark("ts", f"{delay} seconds"), list(active.values()), evidence=True)
        .withColumn("ts_us", F.unix_micros("ts"))
        .withColumn("distinct_field", per_rule(lambda r: r.distinct, "string"))
        .withColumn("closes_us", F.col("window_us") + per_rule(lambda r: micros(r.window) + micros(r.grace), "long"))
        .withColumn("delay_us", F.lit(delay * 1_000_000))
    )
    fired = hits.groupBy("entity_id").transformWithState(
        _Crossing(), _FIRED, outputMode="Append", timeMode="EventTime"
    )
    return as_alerts(
        fired.select(
            F.timestamp_micros("ts_us").alias("detected_at"),
            F.timestamp_micros("window_us").alias("window_start"),
            F.timestamp_micros(F.col("window_us") + per_rule(lambda r: micros(r.window), "long")).alias("window_end"),
            "rule_id",
            per_rule(lambda r: r.name, "string").alias("rule_name"),
            per_rule(lambda r: r.severity, "string").alias("severity"),
            per_rule(lambda r: r.technique, "string").alias("technique"),
            per_rule(lambda r: r.entity_type, "string").alias("entity_type"),
            "entity_id",
            F.col("threshold").alias("observed"),
            "threshold",
            "context",
            F.col("samples").alias("sample_event_ids"),
            "event_id",
        )
    )


# --- sequence detections: carry the last login or session per account ------------------------

_PAIR = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("at_us", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("before_us", T.LongType()),
        T.StructField("before_one", T.StringType()),
        T.StructField("before_two", T.StringType()),
    ]
)


_Pair = Row(*_PAIR.fieldNames())


class _Expiring(StatefulProcessor):
    """One value per account that goes when the watermark passes its time plus a lifetime."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at_us bigint, one string, two string")

    def keep(self, held, value) -> None:
        if value is None or held == value:
            return
        if held:
            self.handle.deleteTimer(held[0] // 1000 + self.ttl_ms)
        self.state.update(value)
        self.handle.registerTimer(value[0] // 1000 + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Position(_Expiring):
    """Last login per account; it only moves forward in time."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        before = tuple(held) if held else None
        for row in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
            if before and before[1] != row["source_country"]:
                yield _Pair(key[0], row["ts_us"], row["event_id"], *before)
            if before is None or row["ts_us"] > before[0]:
                before = (row["ts_us"], row["source_country"], row["source_ip"])
        self.keep(tuple(held) if held else None, before)


class _Session(_Expiring):
    """Fingerprint of the last successful authentication per account."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        session = tuple(held) if held else None
        for row in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
            if row["opens"]:
                session = (row["ts_us"], row["source_ip"], row["user_agent"])
            elif session:
                yield _Pair(key[0], row["ts_us"], row["event_id"], *session)
        self.keep(tuple(held) if held else None, session)


_SIDE = ["user_id", "ts_us", "event_id", "event_action", "source_country", "source_ip", "user_agent"]
_PAIRED = T.StructType(list(_PAIR) + [T.StructField(c, T.StringType()) for c in _SIDE[3:]])


_Paired = Row(*_PAIRED.fieldNames())


class _WithRow:
    """Adds the event's own columns to what the processor pairs it with."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        by_event = {(r["ts_us"], r["event_id"]): r for r in rows}
        for pair in super().handleInputRows(key, rows, timerValues):
            row = by_event[pair[1], pair[2]]
            yield _Paired(*pair, *[row[c] for c in _SIDE[3:]])


class _PositionRows(_WithRow, _Position):
    pass


class _SessionRows(_WithRow, _Session):
    pass


def stream_travel(
    events: DataFrame, max_gap: str = "1 hour", ttl: str = LOGIN_TTL, delay: str = "1 hour"
) -> DataFrame:
    """Impossible travel on a stream, in order of arrival between micro-batches."""
    reach_package(events.sparkSession)
    logins = events.withWatermark("ts", delay).filter(
        (F.col("event_action") == "user-login") & succeeded()
        & F.col("user_id").isNotNull() & F.col("source_country").isNotNull()
    ).withColumn("ts_us", F.unix_micros("ts"))
    pairs = logins.select("ts", *_SIDE).groupBy("user_id").transformWithState(
        _PositionRows(seconds(ttl) * 1000), _PAIRED, outputMode="Append", timeMode="EventTime"
    )
    gap = F.abs(F.col("at_us") - F.col("before_us"))
    return _sequence_alerts(pairs.filter(gap <= micros(max_gap)), "travel", gap, max_gap)


def stream_hijack(
    events: DataFrame, ttl: str = SESSION_TTL, grace: str = "20 seconds", delay: str = "1 hour"
) -> DataFrame:
    """Session hijack on a stream."""
    reach_package(events.sparkSession)
    from secstream.functions.scalar import network_changed

    opens = is_auth() & succeeded()
    rows = events.withWatermark("ts", delay).filter(
        F.col("user_id").isNotNull() & (opens | (~is_auth() & F.col("source_ip").isNotNull()))
    ).withColumn("ts_us", F.unix_micros("ts")).withColumn("opens", opens)
    pairs = rows.select("ts", *_SIDE, "opens").groupBy("user_id").transformWithState(
        _SessionRows(seconds(ttl) * 1000), _PAIRED, outputMode="Append", timeMode="EventTime"
    )
    age = F.col("at_us") - F.col("before_us")
    moved = network_changed(F.col("before_one"), F.col("source_ip"))
    return _sequence_alerts(pairs.filter(age.between(micros(grace), micros(ttl)) & moved), "hijack", age, grace)


def _sequence_alerts(pairs: DataFrame, kind: str, elapsed, threshold: str) -> DataFrame:
    from secstream.functions.scalar import iso, is_private, text_map
    from secstream.operators.sequence import HIJACK, TRAVEL, whole_seconds

    rows = pairs.withColumn("ts", F.timestamp_micros("at_us")).withColumn("started", F.timestamp_micros("before_us"))
    observed = whole_seconds(elapsed)
    if kind == "travel":
        context = text_map(
            {
                "previous_country": F.col("before_one"), "current_country": F.col("source_country"),
                "previous_ip": F.col("before_two"), "current_ip": F.col("source_ip"),
                "gap_seconds": observed, "max_plausible_gap_seconds": F.lit(seconds(threshold)),
            }
        )
        head = (TRAVEL, F.lit("Two logins too far apart for the time between them"), F.lit("medium"), "T1078")
    else:
        before, now = F.col("before_one"), F.col("source_ip")
        new_client = F.coalesce(F.col("before_two") != F.col("user_agent"), F.lit(False))
        crossed = is_private(before) != is_private(now)
        way = F.when(is_private(before), "internal_to_external").otherwise("external_to_internal")
        context = text_map(
            {
                "session_established_ip": before, "session_established_at": iso(F.col("started")), "observed_ip": now,
                "seconds_into_session": observed, "action": F.col("event_action"),
                "session_established_user_agent": F.when(new_client, F.col("before_two")),
                "observed_user_agent": F.when(new_client, F.col("user_agent")),
                "network_class_change": F.when(crossed, way),
            }
        )
        name = F.when(new_client, "Open session moved: other network, other client").otherwise("Open session moved: other network")
        head = (HIJACK, name, F.when(new_client | crossed, "high").otherwise("medium"), "T1539")
    return as_alerts(
        rows.select(
            *account_alert(*head, started=F.col("started"), observed=observed, threshold=seconds(threshold), context=context)
        )
    )


def stream_deviation(events: DataFrame, baseline_path: str, alerts_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Baseline deviations; the baseline table is read anew for each micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        baseline = batch.sparkSession.read.parquet(baseline_path)
        write_batch(baseline_deviation(batch, baseline), alerts_path, batch_id)

    return start(events, each, checkpoint, **options)
