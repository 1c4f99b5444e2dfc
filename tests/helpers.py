"""Small hand-written inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from secstream.schema import ALERT, FLAT_COLUMNS, FLAT_EVENT
from secstream.operators.rules import Rule

T0 = dt.datetime(2026, 9, 12, 8, 0, 0, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def event(seconds: float = 0, action="user-login", outcome="success", user="u-1", ip="10.0.1.5", **more) -> dict:
    row = dict.fromkeys(FLAT_COLUMNS)
    row |= {
        "event_id": more.pop("id", f"{user}-{seconds}-{action}-{ip}"),
        "ts": at(seconds),
        "ingested_at": at(seconds + 1),
        "event_action": action,
        "event_outcome": outcome,
        "user_id": user,
        "source_ip": ip,
        "user_agent": more.pop("agent", "Firefox"),
        "source_country": more.pop("country", "DE"),
    }
    return row | more


def events(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in FLAT_COLUMNS) for r in rows], FLAT_EVENT)


def failure(seconds, **more) -> dict:
    return event(seconds, outcome="failure", **more)


def alert(seconds, rule="r", severity="high", entity="u-1", kind="user", technique="T1110.001", observed=1, **more):
    row = {
        "alert_id": more.get("id", f"{rule}-{entity}-{seconds:09.1f}"),
        "detected_at": at(seconds),
        "window_start": at(seconds - 60),
        "window_end": at(seconds),
        "rule_id": rule,
        "rule_name": rule.upper(),
        "severity": severity,
        "technique": technique,
        "entity_type": kind,
        "entity_id": entity,
        "observed": observed,
        "threshold": 1,
        "context": {"seen": str(seconds)},
        "sample_event_ids": ["e"],
        "dedupe_key": f"{rule}|{kind}|{entity}",
    }
    return tuple(row[c] for c in ALERT.fieldNames())


def alerts(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT)


def rule(**more) -> Rule:
    base = dict(
        id="r", name="R", severity="high", group_by="user.id", entity_type="user", window="PT5M", threshold=3,
        match={"event.action": "user-login"},
    )
    return Rule(**(base | more))


def collect(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
