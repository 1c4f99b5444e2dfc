"""Folding, risk, incidents, proposals, life cycles and scoring."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from secstream.operators.alerts import fold_alerts, rule_stats, triage
from secstream.operators.incidents import incident_transitions
from secstream.operators.response import action_lifecycle, propose_actions
from secstream.operators.risk import risk_scores, scored_firings, top_risk
from secstream.operators.scoring import detected_runs, matched_alerts, score_overall, score_rules
from secstream.plans.detection import respond
from tests.helpers import T0, alert, alerts, at, event, events

HOUR = 3600


def test_fold_raises_severity_and_keeps_the_first_window(spark):
    stored = fold_alerts(alerts(spark, alert(0, severity="low", observed=3), alert(60, severity="high")), at(60)).collect()
    assert len(stored) == 1
    row = stored[0]
    assert (row["severity"], row["occurrences"], row["observed"], row["active"]) == ("high", 2, 3, True)
    assert row["context"] == {"seen": "60"} and row["window_start"].timestamp() == at(-60).timestamp()


def test_fold_gap(spark):
    rows = [alert(60 * m) for m in (0, 29, 59, 90)]
    stored = fold_alerts(alerts(spark, *rows), at(90 * 60 + 1801)).orderBy("first_detected_at").collect()
    assert [r["occurrences"] for r in stored] == [3, 1]
    assert not any(r["active"] for r in stored)


def test_risk_fold(spark):
    got = respond(alerts(spark, alert(0), alert(6 * HOUR)), at(12 * HOUR))
    assert [r["score"] for r in got.scored.orderBy("detected_at").collect()] == [40.0, 60.0]
    risk = got.risk.first()
    assert (risk["score"], risk["peak_score"], risk["peaked_at"].timestamp()) == (60.0, 60.0, at(6 * HOUR).timestamp())
    assert top_risk(got.risk, at(12 * HOUR)).first()["current_score"] == 30.0
    assert top_risk(got.risk, at(100 * HOUR)).count() == 0


def test_risk_is_capped(spark):
    rows = [alert(i, rule=f"r{i}", severity="critical") for i in range(5)]
    assert respond(alerts(spark, *rows), at(10)).risk.first()["score"] == 300.0


def test_incident_opens_on_accumulated_risk(spark):
    got = respond(alerts(spark, *[alert(0.001 * i, rule=f"r{i}", severity="medium") for i in range(4)]), at(10))
    incident = got.incidents.first()
    assert (incident["alert_count"], incident["severity"], incident["opening_risk"]) == (1, "medium", pytest.approx(60.0))
    assert incident["title"] == "Unusual behaviour: user u-1"
    assert got.stored.filter("incident_id is null").count() == 3


def test_high_severity_opens_at_once_and_later_firings_attach(spark):
    got = respond(alerts(spark, alert(0), alert(60), alert(120, rule="quiet", severity="low")), at(200))
    incident = got.incidents.first()
    assert incident["title"] == "Likely takeover: user u-1"
    assert incident["alert_count"] == 2  # the quiet alert warrants by the entity's score
    assert incident["updated_at"].timestamp() == at(120).timestamp()


def test_proposals(spark):
    got = respond(
        alerts(
            spark, alert(0, technique="T1539"), alert(60, rule="root", severity="critical", technique="T1078.004"),
            alert(0, entity="203.0.113.9", kind="source_ip"), alert(9, entity="203.0.113.8", kind="source_ip", severity="medium"),
        ),
        at(100),
    )
    found = {(r["action"], r["target_id"]): r for r in got.actions.collect()}
    assert set(found) == {("revoke_sessions", "u-1"), ("disable_account", "u-1"), ("block_source_ip", "203.0.113.9")}
    assert not found["revoke_sessions", "u-1"]["requires_approval"] and found["disable_account", "u-1"]["requires_approval"]
    assert found["disable_account", "u-1"]["reason"].startswith("containment starts at a risk of 90, now 140")
    taken = got.actions.withColumn("status", F.when(F.col("action") == "disable_account", "executed").otherwise("rejected"))
    left = propose_actions(got.attached, got.incidents, taken.select("action", "target_type", "target_id", "status"))
    assert {r["action"] for r in left.collect()} == {"revoke_sessions", "block_source_ip"}
    ready = propose_actions(got.attached, got.incidents, auto_execute=True).filter("auto_execute").collect()
    assert [r["action"] for r in ready] == ["revoke_sessions"]


def test_transitions(spark):
    incidents = respond(alerts(spark, alert(0)), at(10)).incidents
    name = incidents.first()["incident_id"]
    steps = ["resolved", "triaged", "contained", "investigating", "resolved", "triaged"]
    rows = [(name, at(100 + i), f"{i}", to, "ann", f"because {i}") for i, to in enumerate(steps)]
    rows.append(("unknown", at(0), "0", "triaged", "ann", None))
    requests = spark.createDataFrame(rows, "incident_id string, at timestamp, seq string, to string, actor string, note string")
    final, log = incident_transitions(incidents, requests)
    assert [r["accepted"] for r in log.orderBy("seq").collect()] == [False, True, True, True, True, False]
    row = final.first()
    assert (row["status"], row["resolution"], row["closed_at"].timestamp()) == ("resolved", "because 4", at(104).timestamp())


def test_action_lifecycle(spark):
    actions = respond(alerts(spark, alert(0, technique="T1539")), at(10)).actions
    name = actions.first()["action_id"]
    steps = ["reverted", "approved", "executed", "reverted", "executed"]
    rows = [(name, at(100 + i), f"{i}", to, "bob", f"step {i}") for i, to in enumerate(steps)]
    log_in = spark.createDataFrame(rows, "action_id string, at timestamp, seq string, to string, actor string, detail string")
    final, log = action_lifecycle(actions, log_in)
    assert [r["accepted"] for r in log.orderBy("seq").collect()] == [False, True, True, True, False]
    row = final.first()
    assert (row["status"], row["approved_by"], row["reverted_by"]) == ("reverted", "bob", "bob")
    fixed, log = action_lifecycle(actions.withColumn("reversible", F.lit(False)), log_in)
    assert [r["accepted"] for r in log.orderBy("seq").collect()] == [False, True, True, False, False]


def test_triage_takes_the_newest_valid_verdict(spark):
    stored = fold_alerts(alerts(spark, alert(0), alert(0, entity="u-2")), at(1))
    ids = [r["id"] for r in stored.orderBy("entity_id").collect()]
    rows = [(ids[0], "benign", "ann", "", at(1)), (ids[0], "true_positive", "bob", "", at(2)), (ids[0], "perhaps", "eve", "", at(3))]
    verdicts = spark.createDataFrame(rows, "id string, verdict string, analyst string, note string, at timestamp")
    done = triage(stored, verdicts)
    assert {r["id"]: r["triage"] for r in done.collect()} == {ids[0]: "true_positive", ids[1]: "untriaged"}
    assert rule_stats(done).first()["precision"] == 1.0


def labelled(seconds, run, scenario="bf", **more):
    return event(seconds, labels={"scenario": scenario, "run_id": run, "attack_technique": "T1"}, **more)


def test_scoring_credits_every_overlapping_run(spark):
    ev = events(spark, [labelled(0, "a"), labelled(300, "a", id="a2"), labelled(200, "b"), labelled(9000, "c", user="u-9"), labelled(-40000, "old", user="u-3")])
    stored = fold_alerts(alerts(spark, alert(250), alert(100, entity="u-7"), alert(-40000, entity="u-3"), alert(-38300, entity="u-3")), at(0))
    now = at(9000)
    got = matched_alerts(ev, stored, now, "6 hours", "20 minutes")
    assert {r["entity_id"]: r["matched"] for r in got.collect()} == {"u-1": True, "u-7": False}
    runs = detected_runs(ev, stored, now, "6 hours", "20 minutes")
    assert {r["run_id"]: r["detected"] for r in runs.collect()} == {"a": True, "b": True, "c": False}
    row = score_overall(got, runs).first()
    assert (row["precision"], row["recall"]) == (0.5, pytest.approx(2 / 3))
    # Opened before the window, still firing inside it: selected by its last firing. What fired later is not seen yet.
    assert {r["entity_id"] for r in matched_alerts(ev, stored, at(-17000), "6 hours").collect()} == {"u-3"}


def test_zero_denominators_are_null(spark):
    none = events(spark, [event(0)])
    stored = fold_alerts(alerts(spark, alert(0)), at(0))
    later = at(10 * 86400)
    row = score_overall(matched_alerts(none, stored, later), detected_runs(none, stored, later)).first()
    assert row["precision"] is None and row["recall"] is None and row["f1"] is None
    assert score_rules(matched_alerts(none, stored, later)).count() == 0
