"""Look-backs end at their moment, lists are whole, and hostile input is neither lost nor misread."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from secstream.functions.scalar import at_most, is_address, recent
from secstream.operators import cloud, hunting, lake
from secstream.operators.response import action_lifecycle, audit_subject, audit_trail
from secstream.streaming.ingest import stream_dedupe
from secstream.streaming.detect import _Crossing
from tests.helpers import T0, at, event, events


def test_what_comes_after_the_moment_is_not_recent(spark):
    ev = events(spark, [event(-10, id="a"), event(0, id="b"), event(10, id="c"), event(-4000, id="d")])
    assert {r["event_id"] for r in recent(ev, at(0), "1 hour").collect()} == {"a", "b"}
    days = lake.with_day(ev)
    assert {r["event_id"] for r in recent(days, at(0), "1 hour").collect()} == {"a", "b"}


def test_lists_return_every_row_unless_told_otherwise(spark):
    ev = events(spark, [event(-k, id=f"e{k}") for k in range(700)])
    assert hunting.recent_events(ev, at(0)).count() == 700
    assert hunting.recent_events(ev, at(0), 600).count() == 600
    with pytest.raises(ValueError, match="limit"):
        at_most(ev, 0)


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ("10.0.0.1", True), ("256.1.1.1", False), ("::", True), ("::1", True), ("1::", True), ("::ffff:10.0.0.1", True),
        ("64:ff9b::10.0.0.1", True), ("2001:db8:0:0:0:0:0:1", True), ("1:2:3", False), ("1:2:3:4:5:6:7:8:9", False),
        ("1::2::3", False), ("1:2:3:4:5:6:7::", True), ("1:2:3:4:5:6:7:8::", False), ("12345::1", False), (":1:2", False),
        ("1:2:3:4:5:6:10.0.0.1", True), ("1:2:3:4:5:6:7:10.0.0.1", False), ("not-an-address", False), ("1:2:3:4:5:6:7:", False), (":", False), ("", False),
    ],
)
def test_addresses(spark, text, valid):
    assert spark.range(1).select(is_address(F.lit(text))).first()[0] is valid


def test_pivot_matches_whole_values(spark):
    rows = [event(0, id="a", ip="10.0.1.5"), event(1, id="b", ip="10.0.1.50"), event(2, id="c", ip="9.9.9.9", raw='{"via":"10.0.1.5"}'), event(3, id="d", ip="9.9.9.9", raw='{"via":"10.0.1.5.6"}'), event(90_000, id="e", ip="10.0.1.5")]
    ev = events(spark, rows)
    assert {r["event_id"] for r in hunting.entity_pivot(ev, "10.0.1.5").collect()} == {"a", "c", "e"}
    assert {r["event_id"] for r in hunting.entity_pivot(ev, "10.0.1.5", at(10), "1 hour").collect()} == {"a", "c"}
    assert {r["event_id"] for r in hunting.entity_pivot(ev, "10.0.1.0/24").collect()} == {"a", "b", "e"}


def test_broken_deliveries_are_counted(spark):
    good = '{"eventVersion":"1","eventName":"CreateUser","eventID":"1","eventTime":"2026-01-01T00:00:00Z"}'
    texts = [good, f'{{"Records":[{good},{good}]}}', f"[{good}]", good[:40], "not json", "", None, '{"Records":[]}', "{}"]
    deliveries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, value string")
    failed = {r["n"]: r["failure_reason"] for r in cloud.cloud_failures(deliveries).collect()}
    assert sorted(failed) == [3, 4, 5, 6, 7, 8]
    assert failed[4] == "delivery is not JSON" and failed[5] == "empty delivery" and failed[7] == "delivery holds no audit record"


def actions_frame(spark):
    rows = [("x1", "disable_account", "user", "u-1", "why", "proposed", True, True, T0), ("x2", "revoke_sessions", "user", "u-1", "why", "proposed", False, True, T0)]
    return spark.createDataFrame(rows, "action_id string, action string, target_type string, target_id string, reason string, status string, requires_approval boolean, reversible boolean, proposed_at timestamp")


def test_what_needs_approval_is_not_executed_without(spark):
    actions = actions_frame(spark)
    steps = [(n, at(100 + i), f"{i}", to, "bob", "d") for n in ("x1", "x2") for i, to in enumerate(["executed", "approved", "executed", "reverted"])]
    final, log = action_lifecycle(actions, spark.createDataFrame(steps, "action_id string, at timestamp, seq string, to string, actor string, detail string"))
    took = {n: [r["accepted"] for r in log.filter(F.col("action_id") == n).orderBy("seq").collect()] for n in ("x1", "x2")}
    assert took == {"x1": [False, True, True, True], "x2": [True, False, False, True]}
    assert {r["status"] for r in final.collect()} == {"reverted"}
    assert {r["left"] for r in log.collect()} <= {"proposed", "approved", "executed", "reverted"}


def test_action_events_are_audited(spark):
    actions = actions_frame(spark)
    steps = [("x1", at(100), "0", "approved", "ann", "ok"), ("x1", at(101), "1", "failed", "bob", "no route"), ("x2", at(102), "0", "rejected", "ann", "no")]
    _, log = action_lifecycle(actions, spark.createDataFrame(steps, "action_id string, at timestamp, seq string, to string, actor string, detail string"))
    none = spark.createDataFrame([], "incident_id string, opened_at timestamp, entity_type string, entity_id string, opening_rule string")
    trail = audit_trail(none, actions, action_log=log)
    got = [(r["action"], r["actor"], r["outcome"]) for r in audit_subject(trail, "user", "u-1").filter("actor <> 'system'").orderBy("at").collect()]
    assert got == [("action_approved", "ann", "success"), ("action_failed", "bob", "failure"), ("action_rejected", "ann", "success")]


def test_stream_dedupe_keeps_one_id_at_two_times(spark, tmp_path):
    rows = [event(0, id="a"), event(0, id="a"), event(5, id="a"), event(6, id="b")]
    ev = events(spark, rows)
    ev.write.parquet(str(tmp_path / "in"))
    stream = stream_dedupe(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_distinct_state_is_bounded_by_the_threshold_alone():
    import inspect

    assert "CAP" not in inspect.getsource(_Crossing)


def test_hot_days_go_only_if_they_verify(spark, tmp_path):
    day = dt.date(2026, 9, 12)
    hot, path = str(tmp_path / "hot"), str(tmp_path / "archive")
    rows = [event(0, id="a"), event(-40 * 86400, id="old"), event(-41 * 86400, id="older"), event(-42 * 86400, id="torn")]
    ev = events(spark, rows)
    lake.with_day(ev).write.partitionBy("year", "month", "day").parquet(hot)
    lake.write_days(ev.filter("event_id IN ('old')"), path)
    lake.write_days(ev.filter("event_id = 'torn'").withColumn("user_id", F.lit("other")), path)
    passing = spark.range(1).select(F.lit("x").alias("check_name"), F.lit("correctness").alias("category"), F.lit(True).alias("passed"))
    for dry_run in (True, False):
        done = lake.daily_maintenance(ev, passing, day, path, hot_path=hot, dry_run=dry_run)
        assert done["retention"] == [day - dt.timedelta(days=40)]
        assert done["kept_unverified"] == [day - dt.timedelta(days=42), day - dt.timedelta(days=41)]
        left = {r["event_id"] for r in spark.read.parquet(hot).collect()}
        assert left == {"a", "old", "older", "torn"} - (set() if dry_run else {"old"})
    assert {r["event_id"] for r in lake.read_archive(spark, path).collect()} == {"a", "old", "torn"}
