"""Threshold rules over one scan of the events.

A rule fires on the one event that brings an (entity, window) to its threshold. Rules that count
events rank them and keep those up to the threshold; Spark turns ``row_number() <= n`` into a group
limit in front of the only exchange, so a hot entity leaves each map task with ``n`` rows at most. The
rows kept are those up to the crossing, hence the evidence as well. Rules that count distinct values
take the first arrival of each value, pre-aggregated, and read their evidence in a second scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secstream.functions.fields import FIELD_COLUMNS, field
from secstream.functions.scalar import dedupe_key, iso, micros, text_map
from secstream.operators.rules import Rule, compile_match
from secstream.schema import ALERT_COLUMNS
from secstream.session import materialise

GROUP = ["rule_id", "entity_id", "window_us"]
SAMPLES = 5
CONTEXT_VALUES = 8
DISTINCT_SHOWN = 10


def _window_us(rule: Rule) -> Column:
    at = F.unix_micros("ts")
    return at - F.pmod(at, F.lit(micros(rule.window)))


def rule_hits(ev: DataFrame, rules: list[Rule], evidence: bool = False) -> DataFrame:
    """One row per event and matching rule, from a single filtered scan."""
    tags = []
    for rule in rules:
        parts = [
            F.lit(rule.id).alias("rule_id"),
            field(rule.group_by).alias("entity_id"),
            _window_us(rule).alias("window_us"),
            F.lit(rule.threshold).cast("long").alias("threshold"),
            (field(rule.distinct) if rule.distinct else F.lit(None).cast("string")).alias("counted"),
        ]
        if evidence:
            facts = [
                F.struct(F.lit(path).alias("name"), field(path).alias("item"))
                for path in rule.context_fields
            ]
            empty = F.array().cast("array<struct<name:string,item:string>>")
            parts.append((F.array(*facts) if facts else empty).alias("facts"))
        tags.append(F.when(_matches(rule), F.struct(*parts)))
    any_match = reduce(lambda a, b: a | b, [_matches(rule) for rule in rules])
    return (
        ev.filter(any_match)
        .select("ts", "event_id", F.explode(F.array(*tags)).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select("ts", "event_id", "hit.*")
    )


def _matches(rule: Rule) -> Column:
    return compile_match(rule) & field(rule.group_by).isNotNull()


def _ranked(arrivals: DataFrame, top: int) -> DataFrame:
    """The arrivals of each group up to the threshold, with their position."""
    order = Window.partitionBy(*GROUP).orderBy("ts", "event_id")
    return (
        arrivals.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top)
        .filter(F.col("position") <= F.col("threshold"))
    )


def _nth(arrivals: DataFrame, top: int) -> DataFrame:
    """The arrival whose position in its group equals the threshold."""
    return _ranked(arrivals, top).filter(F.col("position") == F.col("threshold")).drop("position")


def _up_to_crossing(ev: DataFrame, rules: list[Rule]) -> DataFrame:
    """Of groups that reach the threshold of a counting rule, all hits up to the crossing."""
    ranked = _ranked(rule_hits(ev, rules, evidence=True), max(rule.threshold for rule in rules))
    reached = F.max("position").over(Window.partitionBy(*GROUP))
    return ranked.withColumn("_reached", reached).filter(F.col("_reached") == F.col("threshold")).drop("_reached")


def threshold_crossings(ev: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_id, entity_id, window_us, threshold, ts, event_id`` of each crossing event."""
    columns = [*GROUP, "threshold", "ts", "event_id"]
    active = [rule for rule in rules if rule.enabled]
    by_event = [rule for rule in active if not rule.distinct]
    by_value = [rule for rule in active if rule.distinct]
    found = []
    if by_event:
        found.append(_nth(rule_hits(ev, by_event), max(r.threshold for r in by_event)))
    if by_value:
        first = (
            rule_hits(ev, by_value)
            .filter(F.col("counted").isNotNull())
            .groupBy(*GROUP, "threshold", "counted")
            .agg(F.min(F.struct("ts", "event_id")).alias("first"))
            .select(*GROUP, "threshold", "first.ts", "first.event_id")
        )
        found.append(_nth(first, max(r.threshold for r in by_value)))
    return reduce(
        DataFrame.unionByName, [part.select(*columns) for part in found]
    )


def window_state(ev: DataFrame, rules: list[Rule]) -> DataFrame:
    """Final state per (rule, entity, window): events, distinct values, first and last seen."""
    return (
        rule_hits(ev, [rule for rule in rules if rule.enabled])
        .groupBy(*GROUP, "threshold")
        .agg(
            F.count("*").alias("events"),
            F.countDistinct("counted").alias("distinct_values"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )


def window_evidence(ev: DataFrame, rules: list[Rule]) -> DataFrame:
    """What the state of every window holds beside its counts, whether or not it reached the threshold: the first
    events, and the first values of each context field with a mark where there are more."""
    active = [rule for rule in rules if rule.enabled]
    shown = _evidence(rule_hits(ev.select("ts", "event_id", *FIELD_COLUMNS.values()), active, evidence=True))
    paths = sorted({path for rule in active for path in rule.context_fields})
    return shown.select(
        *GROUP, "events_in_window", "first_seen", "last_seen",
        _named(F.lit("")).alias("sample_event_ids"), text_map({path: _shown(F.lit(path)) for path in paths}).alias("context"),
    )


def _before(ev: DataFrame, rules: list[Rule], crossings: DataFrame) -> DataFrame:
    """Hits up to and including the crossing of their group."""
    cut = crossings.select(*GROUP, F.struct("ts", "event_id").alias("cut"))
    hits = rule_hits(ev, rules, evidence=True).join(cut, GROUP)
    return hits.filter(F.struct("ts", "event_id") <= F.col("cut")).drop("cut")


def _evidence(seen: DataFrame) -> DataFrame:
    """What an analyst needs to see, taken from the events up to and including the crossing."""
    totals = seen.groupBy(*GROUP).agg(
        F.count("*").alias("events_in_window"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    fact = F.explode(
        F.concat(
            F.array(
                F.struct(F.lit("").alias("name"), F.col("event_id").alias("item")),
                F.struct(F.lit("distinct").alias("name"), F.col("counted").alias("item")),
            ),
            "facts",
        )
    )
    first_use = Window.partitionBy(*GROUP, "name").orderBy("arrived", "item")
    keep = (
        F.when(F.col("name") == "", SAMPLES)
        .when(F.col("name") == "distinct", DISTINCT_SHOWN + 1)
        .otherwise(CONTEXT_VALUES + 1)
    )
    shown = (
        seen.select(*GROUP, F.struct("ts", "event_id").alias("arrived"), fact.alias("fact"))
        .filter(F.col("fact.item").isNotNull())
        .groupBy(*GROUP, F.col("fact.name").alias("name"), F.col("fact.item").alias("item"))
        .agg(F.min("arrived").alias("arrived"))
        .withColumn("position", F.row_number().over(first_use))
        .filter(F.col("position") <= DISTINCT_SHOWN + 1)
        .filter(F.col("position") <= keep)
        .groupBy(*GROUP, "name")
        .agg(F.sort_array(F.collect_list(F.struct("position", "item")))["item"].alias("items"))
        .groupBy(*GROUP)
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("shown"))
    )
    return totals.join(shown, GROUP)


def _named(name: Column) -> Column:
    return F.coalesce(F.try_element_at("shown", name), F.array().cast("array<string>"))


def _shown(name: Column) -> Column:
    """The first values of a field, with a mark where there are more; null where there are none."""
    values = _named(name)
    more = F.when(F.size(values) > CONTEXT_VALUES, ", …").otherwise("")
    return F.when(F.size(values) > 0, F.concat(F.array_join(F.slice(values, 1, CONTEXT_VALUES), ", "), more))


def threshold_alerts(ev: DataFrame, rules: list[Rule], evidence: bool = True) -> DataFrame:
    """Alerts of all enabled rules, with evidence. Finds the crossings at once, the rest is lazy.

    Without ``evidence`` they lack ``context`` and ``sample_event_ids``, and the events are read for the crossings only.
    """
    active = [rule for rule in rules if rule.enabled]
    ev = ev.select("ts", "event_id", *FIELD_COLUMNS.values())
    if not evidence:
        return _rule_alerts(threshold_crossings(ev, active), active, [])
    # Written: each part is read twice, and Spark sees how small it is.
    columns = [*GROUP, "threshold", "ts", "event_id"]
    by_event = [rule for rule in active if not rule.distinct]
    by_value = [rule for rule in active if rule.distinct]
    parts = []
    if by_event:
        kept = materialise(_up_to_crossing(ev, by_event), "up-to-crossing")
        parts.append((kept.filter(F.col("position") == F.col("threshold")).select(*columns), kept.drop("position")))
    if by_value:
        crossed = materialise(threshold_crossings(ev, by_value), "crossings")
        parts.append((crossed, _before(ev, by_value, crossed)))
    crossings = reduce(DataFrame.unionByName, [crossing for crossing, _ in parts])
    rows = crossings.join(_evidence(reduce(DataFrame.unionByName, [seen for _, seen in parts])), GROUP)
    distinct_field = _per_rule(active, lambda r: r.distinct).cast("string")
    values = _named(F.lit("distinct"))
    sample = F.concat(
        F.array_join(F.slice(values, 1, DISTINCT_SHOWN), ", "),
        F.when(F.size(values) > DISTINCT_SHOWN, ", …").otherwise(""),
    )
    counted = distinct_field.isNotNull()
    paths = sorted({path for rule in active for path in rule.context_fields})
    context = text_map(
        {
            "events_in_window": F.col("events_in_window"),
            "distinct_field": distinct_field,
            "distinct_count": F.when(counted, F.col("threshold")),
            "distinct_sample": F.when(counted, sample),
            **{path: _shown(F.lit(path)) for path in paths},
            "first_seen": iso(F.col("first_seen")),
            "last_seen": iso(F.col("last_seen")),
        }
    )
    return _rule_alerts(rows, active, [context.alias("context"), _named(F.lit("")).alias("sample_event_ids")])


def _per_rule(rules: list[Rule], value) -> Column:
    choice = None
    for rule in rules:
        branch = F.lit(value(rule))
        test = F.col("rule_id") == rule.id
        choice = F.when(test, branch) if choice is None else choice.when(test, branch)
    return choice


def _rule_alerts(rows: DataFrame, rules: list[Rule], evidence: list[Column]) -> DataFrame:
    def per_rule(value) -> Column:
        return _per_rule(rules, value)

    return as_alerts(
        rows.select(
            F.col("ts").alias("detected_at"),
            F.timestamp_micros("window_us").alias("window_start"),
            F.timestamp_micros(
                F.col("window_us") + per_rule(lambda r: micros(r.window)).cast("long")
            ).alias("window_end"),
            "rule_id",
            per_rule(lambda r: r.name).alias("rule_name"),
            per_rule(lambda r: r.severity).alias("severity"),
            per_rule(lambda r: r.technique).alias("technique"),
            per_rule(lambda r: r.entity_type).alias("entity_type"),
            "entity_id",
            F.col("threshold").alias("observed"),
            "threshold",
            *evidence,
            "event_id",
        )
    )


def as_alerts(rows: DataFrame) -> DataFrame:
    """Give finished alert columns their deterministic id and dedupe key."""
    identity = F.concat_ws(
        "|", "rule_id", "entity_id", F.unix_micros("window_start").cast("string"), "event_id"
    )
    named = rows.select("*", F.sha2(identity, 256).alias("alert_id"), dedupe_key().alias("dedupe_key"))
    return named.select(*[c for c in ALERT_COLUMNS if c in named.columns])
