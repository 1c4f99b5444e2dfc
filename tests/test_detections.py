"""Detections on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from secstream.functions.fields import field
from secstream.operators.baseline import user_baseline
from secstream.operators.rules import load_rules, parse_rule
from secstream.operators.sequence import baseline_deviation, impossible_travel, session_hijack
from secstream.operators.threshold import threshold_alerts, threshold_crossings, window_state
from tests.helpers import T0, at, collect, event, events, failure, plan, rule

STANDARD = load_rules()


def fired(spark, rows, rules=STANDARD):
    return {(r["rule_id"], r["entity_id"]): r for r in threshold_alerts(events(spark, rows), rules).collect()}


def test_brute_force_fires_once_at_the_threshold(spark):
    found = fired(spark, [failure(2 * i, ip="203.0.113.9") for i in range(25)])
    assert list(found) == [("brute-force-single-account", "u-1")]
    row = found["brute-force-single-account", "u-1"]
    assert row["observed"] == row["threshold"] == 10
    assert len(row["sample_event_ids"]) == 5
    assert row["context"]["source.ip"] == "203.0.113.9" and row["context"]["events_in_window"] == "10"
    assert row["detected_at"].timestamp() == at(18).timestamp()


def test_successes_and_slow_failures_do_not_fire(spark):
    assert not fired(spark, [event(i) for i in range(50)])
    assert not fired(spark, [failure(600 * i) for i in range(20)])


def test_distinct_sources(spark):
    one = [failure(i, ip="203.0.113.9") for i in range(9)]
    five = [failure(i, ip=f"203.0.113.{i}") for i in range(5)]
    assert not fired(spark, one)
    found = fired(spark, five)
    assert found["distributed-brute-force", "u-1"]["context"]["distinct_field"] == "source.ip"


def test_stuffing_is_reported_on_the_source(spark):
    found = fired(spark, [failure(2 * i, user=f"u-{i}", ip="198.51.100.7") for i in range(30)])
    assert list(found) == [("credential-stuffing-source", "198.51.100.7")]
    context = found["credential-stuffing-source", "198.51.100.7"]["context"]
    assert context["distinct_count"] == "20" and context["distinct_sample"].endswith(", …")


def test_window_state_counts_past_the_threshold(spark):
    many = events(spark, [event(i, ip=f"10.0.{i % 12}.1") for i in range(20)])
    assert threshold_crossings(many, [rule()]).count() == 1
    state = window_state(many, [rule(distinct="source.ip")]).first()
    assert (state["events"], state["distinct_values"]) == (20, 12)


def test_evidence_is_bounded_and_ordered(spark):
    rows = [event(i, ip=f"10.0.{i}.1") for i in range(20)]
    row = fired(spark, rows, [rule(threshold=15, context_fields=["source.ip"])])["r", "u-1"]
    assert row["context"]["source.ip"] == ", ".join(f"10.0.{i}.1" for i in range(8))
    assert row["sample_event_ids"] == [r["event_id"] for r in rows[:5]]


def test_distinct_value_must_be_new(spark):
    rows = [event(i, ip="10.0.0.1") for i in range(10)] + [event(20, ip="10.0.0.2"), event(30, ip="10.0.0.3")]
    got = threshold_crossings(events(spark, rows), [rule(distinct="source.ip")]).collect()
    assert [r["event_id"] for r in got] == [rows[-1]["event_id"]]


def test_null_entities_and_null_fields_never_match(spark):
    rows = [event(i, user=None, id=f"x{i}") for i in range(5)] + [event(i, action=None, id=f"y{i}") for i in range(5)]
    assert not fired(spark, rows, [rule()])


def test_hot_group_is_limited_before_the_shuffle(small):
    from secstream.plans.queries import WEEKLY

    text = plan(threshold_crossings(small.ev, WEEKLY))
    assert text.count("row_number(), 6, Partial") == 1  # rules that count events
    assert text.count("row_number(), 10, Partial") == 1  # rules that count distinct values


@pytest.mark.parametrize(
    "change, message",
    [
        ({"group_by": "user.emial"}, "unknown group_by field"),
        ({"match": {"user.emial": "x"}}, "unknown match field"),
        ({"grace": "PT10M"}, "grace must not exceed"),
        ({"threshold": 0}, "threshold must be > 0"),
        ({"window": "PT0S"}, "window must be"),
        ({"severity": "urgent"}, "unknown severity"),
        ({"typo": 1}, "typo"),
    ],
)
def test_rule_validation(change, message):
    base = {"id": "r", "name": "R", "severity": "low", "group_by": "user.id", "entity_type": "user", "window": "PT5M", "threshold": 3}
    with pytest.raises(ValueError, match=message):
        parse_rule(base | change)


def test_rule_directories(tmp_path):
    entry = {"id": "r", "name": "R", "severity": "low", "group_by": "user.id", "entity_type": "user", "window": "PT5M", "threshold": 3}
    (tmp_path / "a.json").write_text(json.dumps(entry | {"enabled": False}))
    loaded = load_rules(tmp_path)
    assert not loaded[0].enabled and loaded[0].grace == "PT1M"
    (tmp_path / "b.json").write_text(json.dumps([entry]))
    with pytest.raises(ValueError, match="duplicate"):
        load_rules(tmp_path)
    assert len(STANDARD) == 10


def test_disabled_rules_are_skipped(spark):
    assert not fired(spark, [event(i) for i in range(5)], [rule(enabled=False), rule(id="other", threshold=99)])


def test_unknown_path_fails_early(spark):
    assert field("source.geo.city_name") is not None
    with pytest.raises(ValueError, match="user.emial"):
        field("user.emial")


def test_impossible_travel(spark):
    rows = [event(0, country="DE"), event(240, country="SG", ip="203.0.113.4")]
    row = impossible_travel(events(spark, rows)).collect()
    assert len(row) == 1 and row[0]["observed"] == 240
    assert (row[0]["context"]["previous_country"], row[0]["context"]["current_country"]) == ("DE", "SG")
    assert not impossible_travel(events(spark, [event(0, country="DE"), event(3601, country="SG")])).collect()


def test_travel_ties_do_not_move_the_position(spark):
    rows = [event(0, country="DE", id="a"), event(0, country="SG", id="b"), event(60, country="DE", id="c")]
    assert collect(impossible_travel(events(spark, rows)), "window_end", "observed") == [(at(0).replace(tzinfo=None), 0)]


def hijacks(spark, *rows):
    return session_hijack(events(spark, rows)).collect()


TOKEN = dict(action="token-issued")
USE = dict(action="permission-check")


def test_hijack_of_network_and_client(spark):
    got = hijacks(spark, event(0, **TOKEN), event(90, ip="203.0.113.9", agent="python", **USE))
    assert [r["severity"] for r in got] == ["high"]
    assert got[0]["context"]["network_class_change"] == "internal_to_external"


def test_hijack_private_move_is_medium(spark):
    got = hijacks(spark, event(0, ip="10.0.5.5", **TOKEN), event(90, ip="10.9.9.9", **USE))
    assert [r["severity"] for r in got] == ["medium"]


@pytest.mark.parametrize(
    "rows",
    [
        [event(0, **TOKEN), event(90, ip="10.0.1.88", **USE)],
        [event(0, **TOKEN)] + [failure(10 + i, ip=f"203.0.113.{i}") for i in range(5)],
        [event(0, **TOKEN), event(60, ip="203.0.113.9"), event(120, ip="203.0.113.9", **USE)],
        [event(0, **TOKEN), event(5, ip="203.0.113.9", **USE)],
        [event(90, ip="203.0.113.9", **USE)],
        [event(0, **TOKEN), event(8 * 3600 + 1, ip="203.0.113.9", **USE)],
    ],
    ids=["same /24", "failed logins", "logged in again", "grace", "no session", "expired"],
)
def test_no_hijack(spark, rows):
    assert not hijacks(spark, *rows)


def test_deviation_severity(spark):
    history = events(spark, [event(-86400 + 3600 * h + i, id=f"h{h}-{i}") for h in range(1, 13) for i in range(2)])
    base = user_baseline(history, T0, 7)
    hour = 9 * 3600  # 17:00; the history covers 09:00 to 20:00
    cases = {"none": event(hour), "low": event(hour, country="SG"), "medium": event(hour, country="SG", agent="curl"),
             "high": event(23 * 3600, country="SG", agent="curl")}
    for severity, row in cases.items():
        got = baseline_deviation(events(spark, [row]), base).collect()
        assert [r["severity"] for r in got] == ([] if severity == "none" else [severity])
    asleep = base.withColumn("dormant_days", F.lit(31.0))
    assert baseline_deviation(events(spark, [cases["high"]]), asleep).first()["observed"] == 4
    assert not baseline_deviation(events(spark, [cases["high"]]), base.withColumn("total_events", F.lit(19))).collect()
    short = base.withColumn("active_hours", F.array(F.lit(9)))
    assert baseline_deviation(events(spark, [cases["high"]]), short).first()["observed"] == 2


def test_detections_are_blind_to_labels(spark, small):
    from secstream.plans.detection import detect
    from secstream.plans.queries import WEEKLY

    blank = small.ev.withColumn("labels", F.lit(None).cast("map<string,string>"))
    got, want = detect(blank, WEEKLY, small.history), small.alerts
    assert collect(got, "alert_id", "severity") == collect(want, "alert_id", "severity")
