"""Incidents: opened on accumulated risk or severity, moved along a fixed life cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secstream.functions.ordered import running_before, sliced_fold, stepwise
from secstream.functions.scalar import at_least, at_most, severity_name, severity_rank
from secstream.session import materialise

# Statuses, legal moves, and the risk at which an incident opens.
MOVES = {
    "new": ["triaged", "false_positive"],
    "triaged": ["investigating", "contained", "resolved", "false_positive"],
    "investigating": ["contained", "resolved", "false_positive"],
    "contained": ["investigating", "resolved"],
    "resolved": [],
    "false_positive": [],
}
TERMINAL = ["resolved", "false_positive"]
OPEN_AT = 50


def attached_firings(scored: DataFrame, threshold: float = OPEN_AT, attached_before: DataFrame | None = None) -> DataFrame:
    """Firings that belong to an incident.

    A firing warrants an incident by risk or by severity. From the first warranting firing of a
    stored alert on, all firings of that stored alert are attached; so are all firings of the stored
    alerts in ``attached_before`` (``stored_id``), which earlier batches have attached.
    """
    moment = F.struct("detected_at", "alert_id")
    warrants = (F.col("score") >= threshold) | at_least(F.col("severity"), "high")
    since = (
        scored.filter(warrants).groupBy("stored_id").agg(F.min(moment).alias("_since"))
    )
    if attached_before is None:
        return scored.join(since, "stored_id").filter(moment >= F.col("_since")).drop("_since")
    known = attached_before.select("stored_id", F.lit(True).alias("_known"))
    both = scored.join(since, "stored_id", "left").join(known, "stored_id", "left")
    return both.filter(F.coalesce(F.col("_known"), moment >= F.col("_since"))).drop("_since", "_known")


def open_incidents(attached: DataFrame) -> DataFrame:
    """One open incident per entity, from its attached firings."""
    moment = F.struct("detected_at", "alert_id")
    rank = severity_rank(F.col("severity"))
    grown = F.max(F.when(rank >= 2, rank))
    opening = F.min_by(F.struct("alert_id", "rule_id", "severity", "score"), moment)
    first_rank = severity_rank(F.col("_first.severity"))
    suspected = F.when(first_rank >= 3, "Likely takeover").otherwise("Unusual behaviour")
    return (
        attached.groupBy("entity_type", "entity_id")
        .agg(
            opening.alias("_first"),
            grown.alias("_grown"),
            F.max_by("score", moment).alias("risk_score"),
            F.min("detected_at").alias("opened_at"),
            F.max("detected_at").alias("updated_at"),
            F.countDistinct("stored_id").alias("alert_count"),
        )
        .select(
            F.sha2(F.concat_ws("|", F.lit("incident"), "entity_type", "entity_id", "_first.alert_id"), 256).alias("incident_id"),
            F.lit("new").alias("status"),
            severity_name(F.greatest(first_rank, F.coalesce("_grown", F.lit(0)))).alias("severity"),
            F.concat(suspected, F.lit(": "), "entity_type", F.lit(" "), "entity_id").alias("title"),
            "entity_type",
            "entity_id",
            "risk_score",
            "opened_at",
            "updated_at",
            F.col("_first.rule_id").alias("opening_rule"),
            F.col("_first.score").alias("opening_risk"),
            "alert_count",
        )
    )


_HISTORY = ["entity_type", "entity_id"]


def incident_history(attached: DataFrame, requests: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All incidents of each entity, one after the other, and the log of the analysts' requests.

    Attached firings and requests (``entity_type, entity_id, at, seq, to, actor, note``) are taken in one order per
    entity. A firing opens an incident if none is open, otherwise it joins the open one; a request moves the open
    one along the legal moves. After a terminal move nothing is open, so the next attached firing opens the next
    incident. ``before`` has the incidents that earlier batches left, of which the newest of each entity may
    still be open; the result holds those that this batch has opened or changed and those of ``before``.
    """
    rank = severity_rank(F.col("severity"))
    firings = attached.select(
        *_HISTORY, F.col("detected_at").alias("at"), F.col("alert_id").alias("seq"), F.lit("new").alias("to"),
        F.struct("alert_id", "rule_id", "severity", "score", "stored_id").alias("firing"),
    )
    asked = F.when(F.col("to") == "new", "refused").otherwise(F.col("to"))
    asks = requests.select(*_HISTORY, "at", "seq", asked.alias("to"), "actor", "note")
    events = firings.unionByName(asks, allowMissingColumns=True)
    # a state that an earlier batch left is entered by a move of its own, open from the beginning only
    held = {} if before is None else {f"held {s}": s for s in MOVES}
    after = {s: [*to, *(["new"] if s in TERMINAL else [])] for s, to in MOVES.items()}
    moves = {"none": ["new", *held]} | after | {h: after[s] for h, s in held.items()}
    newest = None
    if before is not None:
        # several can open at one instant; each but the last was closed before the next one opened
        latest = F.struct("opened_at", ~F.col("status").isin(TERMINAL), "closed_at", "incident_id")
        newest = before.groupBy(*_HISTORY).agg(F.max_by(F.struct("incident_id", "status", "updated_at", "severity"), latest).alias("b"))
        heads = newest.select(*_HISTORY, F.col("b.updated_at").alias("at"), F.lit("").alias("seq"), F.concat(F.lit("held "), "b.status").alias("to"), F.col("b.incident_id").alias("carried"))
        events = events.unionByName(heads, allowMissingColumns=True)
    kept = [c for c in events.columns if c not in (*_HISTORY, "at", "seq", "to")]
    bare = {c: F.regexp_replace(c, "^held ", "") for c in ("found", "left")}
    log = materialise(life_cycle(events, _HISTORY, moves, "none", kept=kept).withColumns(bare), "incident-log")
    opens = F.col("accepted") & ((F.col("to") == "new") | F.col("to").startswith("held "))
    identity = F.sha2(F.concat_ws("|", F.lit("incident"), *_HISTORY, "seq"), 256)
    columns = {"carried": F.lit(None).cast("string")} if before is None else {}
    opened = log.withColumns(columns).withColumn("_opened", F.when(opens, F.coalesce("carried", identity)))
    named = running_before(opened, _HISTORY, "at", ["seq"], {"_open": ("last", F.col("_opened"))})
    named = named.withColumn("incident_id", F.coalesce("_opened", "_open"))

    moment, first = F.struct("at", "seq"), F.col("firing").isNotNull()
    severity = severity_rank(F.col("firing.severity"))
    closing = F.col("accepted") & F.col("left").isin(TERMINAL) & ~F.col("to").startswith("held ")
    real = ~F.col("to").startswith("held ")
    of = named.filter(F.col("incident_id").isNotNull()).groupBy(*_HISTORY, "incident_id").agg(
        F.max_by("left", moment).alias("status"),
        F.min_by("firing", F.when(first, moment)).alias("_first"),
        F.max(F.when(severity >= 2, severity)).alias("_grown"),
        F.max_by("firing.score", F.when(first, moment)).alias("risk_score"),
        F.min(F.when(first, F.col("at"))).alias("opened_at"),
        F.max(F.when(real & (first | F.col("accepted")), F.col("at"))).alias("updated_at"),
        F.max(F.when(closing, F.col("at"))).alias("closed_at"),
        F.max_by("note", F.when(closing, moment)).alias("resolution"),
    )
    first_rank = severity_rank(F.col("_first.severity"))
    grown = F.greatest(first_rank, F.coalesce("_grown", F.lit(0)))
    suspected = F.when(first_rank >= 3, "Likely takeover").otherwise("Unusual behaviour")
    found = of.select(
        "incident_id", "status", severity_name(grown).alias("severity"),
        F.concat(suspected, F.lit(": "), "entity_type", F.lit(" "), "entity_id").alias("title"),
        *_HISTORY, "risk_score", "opened_at", "updated_at", "closed_at", "resolution",
        F.col("_first.rule_id").alias("opening_rule"), F.col("_first.score").alias("opening_risk"),
    )
    requests_log = named.filter(~first & real).select("incident_id", *_HISTORY, "at", "seq", "to", "actor", "note", "found", "left", "accepted")
    # a request that names no entity has no key to be walked by; it finds nothing open
    nobody = asks.filter(F.col("entity_type").isNull() | F.col("entity_id").isNull()).withColumns(
        {"incident_id": F.lit(None).cast("string"), "found": F.lit("none"), "left": F.lit("none"), "accepted": F.lit(False)}
    )
    requests_log = requests_log.unionByName(nobody)
    if before is None:
        return found, requests_log
    return _continued(before, found), requests_log


def _continued(before: DataFrame, found: DataFrame) -> DataFrame:
    """Incidents of earlier batches with what this one has added to them, and the new ones."""
    new = found.select("incident_id", *[F.col(c).alias(f"_{c}") for c in found.columns if c != "incident_id"])
    both = before.join(new, "incident_id", "full")
    rank = F.greatest(severity_rank(F.col("severity")), F.when(severity_rank(F.col("_severity")) >= 2, severity_rank(F.col("_severity"))))
    old = F.col("opened_at").isNotNull()
    kept = ["title", *_HISTORY, "opened_at", "opening_rule", "opening_risk"]
    return both.select(
        "incident_id",
        F.coalesce("_status", "status").alias("status"),
        F.when(old, severity_name(rank)).otherwise(F.col("_severity")).alias("severity"),
        *[F.coalesce(c, f"_{c}").alias(c) for c in kept],
        F.coalesce("_risk_score", "risk_score").alias("risk_score"),
        F.greatest("updated_at", "_updated_at").alias("updated_at"),
        F.coalesce("_closed_at", "closed_at").alias("closed_at"),
        F.coalesce("_resolution", "resolution").alias("resolution"),
    ).select(*before.columns)


def alerts_of_incidents(stored: DataFrame, attached: DataFrame, incidents: DataFrame) -> DataFrame:
    """Stored alerts with the incident they are attached to (null when none)."""
    rows = attached.select(F.col("stored_id").alias("id")).distinct()
    named = stored.join(rows, "id", "left_semi").select("id", "entity_type", "entity_id").join(
        incidents.select("incident_id", "entity_type", "entity_id"), ["entity_type", "entity_id"]
    )
    return stored.join(named.select("id", "incident_id"), "id", "left")


def incident_list(
    incidents: DataFrame, alerts: DataFrame, status: str | None = None, limit: int = 50
) -> DataFrame:
    """Newest incidents with the number of alerts attached to each."""
    counts = (
        alerts.filter(F.col("incident_id").isNotNull())
        .groupBy("incident_id")
        .agg(F.count("*").alias("alert_count"))
    )
    rows = incidents if status is None else incidents.filter(F.col("status") == status)
    return (
        rows.drop("alert_count")
        .join(counts, "incident_id", "left")
        .na.fill(0, ["alert_count"])
        .orderBy(F.desc("updated_at"), "incident_id")
        .transform(at_most, limit)
    )


def incident_detail(
    incidents: DataFrame, alerts: DataFrame, notes: DataFrame, actions: DataFrame, incident_id: str | None = None
) -> DataFrame:
    """Everything on an incident as a timeline, one row per item.

    Rows instead of nested lists: an incident with very many alerts never has to fit in one row.
    Without an id the timelines of all incidents are returned.
    """
    def part(rows: DataFrame, section: str, at: str, item: str, detail: Column) -> DataFrame:
        return rows.select(
            "incident_id",
            F.lit(section).alias("section"),
            F.col(at).alias("at"),
            F.col(item).alias("item"),
            detail.alias("detail"),
        )

    attached = alerts.filter(F.col("incident_id").isNotNull())
    timeline = (
        part(incidents, "incident", "opened_at", "status", F.col("title"))
        .unionByName(part(attached, "alert", "last_detected_at", "id", F.concat_ws("|", "rule_id", "severity", "triage")))
        .unionByName(part(notes, "note", "at", "author", F.col("note")))
        .unionByName(part(actions, "action", "proposed_at", "action", F.concat_ws("|", "target_type", "target_id", "status")))
    )
    return timeline if incident_id is None else timeline.filter(F.col("incident_id") == incident_id)


def life_cycle(
    requests: DataFrame, key: str | Sequence[str], moves: dict[str, list[str]], start: str, width: str = "1 day", kept: Sequence[str] = ()
) -> DataFrame:
    """Walk each key through its requested moves (``key, at, seq, to``) in order.

    A slice of requests maps every state to the state it leads to, so the slices of one key can
    be described in parallel and chained afterwards. Each request comes back with the state it
    found, the state it left and whether it was accepted, and with its ``kept`` columns: joining
    them to the result would shuffle all requests twice more.
    """
    keys, kept, states = [key] if isinstance(key, str) else list(key), list(kept), list(moves)
    legal = F.create_map(
        *[x for s, to in moves.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))]
    )

    def move(state: Column, to: Column) -> Column:
        allowed = F.coalesce(F.array_contains(F.try_element_at(legal, state), to), F.lit(False))
        return F.when(allowed, to).otherwise(state)

    def position(state: Column) -> Column:
        return F.array_position(F.array(*[F.lit(s) for s in states]), state).cast("int")

    def summarise(steps: Column) -> Column:
        ends = [F.aggregate(steps, F.lit(s), lambda state, row: move(state, row["to"])) for s in states]
        return F.array(*ends)

    def step(state, row):
        before = state[0]
        after = row if row in moves[before] else before
        return (after,), after

    outcomes = stepwise(step, "string")

    def replay(state: Column, steps: Column) -> Column:
        before = F.concat(F.array(state["state"]), outcomes(state, steps["to"]))
        zipped = F.arrays_zip(
            steps.alias("s"), F.slice(before, F.lit(1), F.size(steps)).alias("b"), F.slice(before, F.lit(2), F.size(steps)).alias("a")
        )
        return F.transform(
            zipped,
            lambda z: F.struct(
                F.timestamp_micros(z["s"]["at_us"]).alias("at"),
                z["s"]["seq"].alias("seq"),
                z["s"]["to"].alias("to"),
                z["b"].alias("found"),
                z["a"].alias("left"),
                F.array_contains(F.try_element_at(legal, z["b"]), z["s"]["to"]).alias("accepted"),
                *[z["s"][c].alias(c) for c in kept],
            ),
        )

    return sliced_fold(
        requests, keys, "at", ["seq"], ["to", *kept], summarise,
        F.struct(F.lit(start).alias("state")),
        lambda state, ends: F.struct(F.element_at(ends, position(state["state"])).alias("state")),
        replay, width,
    )


def incident_transitions(incidents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply transition requests (``incident_id, at, seq, to, actor, note``).

    Returns the incidents in their final state and the log of all requests with ``accepted``.
    """
    known = requests.join(incidents.select("incident_id"), "incident_id", "left_semi")
    log = life_cycle(known, "incident_id", MOVES, "new", kept=["actor", "note"])
    moment = F.struct("at", "seq")
    closing = F.col("left").isin(TERMINAL)
    ends = (
        log.filter("accepted")
        .groupBy("incident_id")
        .agg(
            F.max_by("left", moment).alias("_status"),
            F.max("at").alias("_moved_at"),
            F.max(F.when(closing, F.col("at"))).alias("closed_at"),
            F.max_by(F.when(closing, F.col("note")), F.when(closing, moment)).alias("resolution"),
        )
    )
    final = (
        incidents.join(ends, "incident_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("updated_at", F.greatest("updated_at", "_moved_at"))
        .drop("_status", "_moved_at")
    )
    return final, log
