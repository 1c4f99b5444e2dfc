"""The detection pipeline as one composition: events to alerts to incidents and proposals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secstream.operators.alerts import alert_positions, alert_union, fold_positions
from secstream.operators.incidents import alerts_of_incidents, attached_firings, open_incidents
from secstream.operators.response import propose_actions
from secstream.operators.risk import risk_scores, scored_firings
from secstream.operators.rules import Rule
from secstream.operators.sequence import baseline_deviation, impossible_travel, session_hijack
from secstream.operators.threshold import threshold_alerts
from secstream.session import materialise


def latest(ev: DataFrame, at: str = "ts") -> Column:
    """The newest event time, as a scalar subquery that stays inside the plan."""
    return ev.agg(F.max(at)).scalar()


def detect(ev: DataFrame, rules: list[Rule], baseline: DataFrame | None = None, max_gap: str = "1 hour", evidence: bool = True) -> DataFrame:
    """All detections. Labels are ground truth and are dropped before anything looks at the events.

    Without ``evidence`` the alerts lack ``context`` and ``sample_event_ids``, which only analysts read.
    """
    blind = ev.drop("labels", "raw")
    parts = [threshold_alerts(blind, rules, evidence), impossible_travel(blind, max_gap), session_hijack(blind)]
    if baseline is not None:
        parts.append(baseline_deviation(blind, baseline))
    return alert_union(*(parts if evidence else [part.drop("context", "sample_event_ids") for part in parts]))


@dataclass
class Response:
    positions: DataFrame
    stored: DataFrame
    scored: DataFrame
    risk: DataFrame
    attached: DataFrame
    incidents: DataFrame
    actions: DataFrame


def attach(alerts: DataFrame, suppression: str = "30 minutes", width: str = "5 minutes") -> tuple[DataFrame, DataFrame]:
    """Attached firings and incidents, as in ``respond``, from alerts that may lack their evidence; both are written."""
    positions = materialise(alert_positions(materialise(alerts, "alerts"), suppression), "positions")
    attached = materialise(attached_firings(materialise(scored_firings(positions, width=width), "scored")), "attached")
    return attached, materialise(open_incidents(attached), "incidents")


def respond(alerts: DataFrame, as_of, suppression: str = "30 minutes", width: str = "5 minutes", stored: bool = False) -> Response:
    """Fold, score, open incidents and propose actions.

    Positions and scores are written once each: everything after them reads them several times. So are the alerts,
    unless they are read from a ``stored`` table.
    """
    alerts = alerts if stored else materialise(alerts, "alerts")
    positions = materialise(alert_positions(alerts, suppression), "positions")
    rows = fold_positions(positions, as_of, suppression)
    scored = materialise(scored_firings(positions, width=width), "scored")
    attached = attached_firings(scored)
    incidents = open_incidents(attached)
    return Response(
        positions,
        alerts_of_incidents(rows, attached, incidents),
        scored,
        risk_scores(scored),
        attached,
        incidents,
        propose_actions(attached, incidents),
    )
