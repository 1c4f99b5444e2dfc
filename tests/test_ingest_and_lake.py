"""Ingest, cloud records, quality checks and the archive."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from secstream.functions import scalar as S
from secstream.operators import cloud, ingest, lake, quality
from secstream.operators.hunting import in_cidr
from secstream.schema import DEAD_LETTER, MESSAGE
from tests.helpers import T0, at, event, events

GOOD = {"@timestamp": "2026-09-12T08:00:00Z", "event": {"id": "e1", "action": "user-login", "outcome": "success"}, "user": {"id": "u-1"}}


def messages(spark, *values):
    rows = [("t", 0, i, "k", v if v is None or isinstance(v, str) else json.dumps(v), at(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, MESSAGE)


def changed(**more):
    return GOOD | more


def test_routing_of_bad_messages(spark):
    values = [
        GOOD, "this is not json", {"@timestamp": "nonsense"}, None, "[]", "5",
        changed(user={}), changed(event={"action": "x"}), {k: v for k, v in GOOD.items() if k != "@timestamp"},
        changed(source={"ip": "nowhere"}), changed(source={"port": "many"}), changed(source={"ip": "2001:db8::1", "port": "80"}, extra=1),
    ]
    got = ingest.validate_events(ingest.parse_events(messages(spark, *values))).orderBy("offset").collect()
    kinds = [r["failure_type"] for r in got]
    parse, valid, persist = "PARSE_ERROR", "VALIDATION_ERROR", "PERSIST_ERROR"
    assert kinds == [None, parse, parse, parse, parse, parse, valid, valid, valid, persist, parse, None]
    assert got[6]["failure_reason"] == "missing required field user.id"


def test_vocabulary_and_null_omission(spark):
    value = changed(event={"id": "e", "action": "TOKEN-ISSUED", "category": "strange", "outcome": None})
    row = ingest.ingest_batch(messages(spark, value)).good.first()
    assert (row["event_action"], row["event_category"], row["event_outcome"]) == ("token-issued", "unknown", None)
    assert "null" not in row["raw"] and "source" not in json.loads(row["raw"])


def test_dedupe_and_replay(spark):
    later = changed(**{"@timestamp": "2026-09-12T09:00:00Z"})
    first = ingest.ingest_batch(messages(spark, GOOD, GOOD, later, "broken"))
    assert first.counters.first().asDict() == {"received": 4, "rejected": 1, "ingested": 2, "duplicates": 1}
    assert ingest.ingest_batch(messages(spark, GOOD), existing=lake.with_day(first.good)).good.count() == 0
    dead = first.dead.withColumn("payload", F.lit(json.dumps(changed(event={"id": "fixed", "action": "x", "outcome": "success"}))))
    again = ingest.dlq_replay(dead, limit=5, as_of=T0)
    assert again.ingested.good.count() == 1 and again.ingested.dead.count() == 0
    assert again.bookkeeping.first()["replay_count"] == 1
    assert ingest.replay_candidates(again.bookkeeping).count() == 0
    assert ingest.replay_candidates(again.bookkeeping, include_replayed=True).count() == 1


def test_long_reasons_are_cut(spark):
    row = ingest.dead_letters(ingest.validate_events(ingest.parse_events(messages(spark, changed(source={"ip": "x" * 900}))))).first()
    assert len(row["failure_reason"]) == 501 and row["failure_reason"].endswith("…")


def test_schema_conformance(spark):
    bad = {"@timestamp": 5, "event": {"id": "e", "outcome": "maybe", "note": "x"}, "user": {}, "labels": {"any": "thing"}, "trace": 1}
    got = {(r["path"], r["problem"]) for r in ingest.schema_conformance(messages(spark, GOOD, bad, "oops")).collect()}
    assert got == {
        ("@timestamp", "wrong_type"), ("event.action", "missing"), ("event.outcome", "wrong_value"), ("event.note", "unknown"),
        ("user.id", "missing"), ("trace", "unknown"), ("$", "not_an_object"),
    }


RECORDS = [
    {"eventName": "ConsoleLogin", "eventSource": "signin.amazonaws.com", "eventID": "1", "eventTime": "2026-09-13T06:14:02Z",
     "sourceIPAddress": "203.0.113.45", "userIdentity": {"type": "IAMUser", "userName": "alice", "accountId": "1"},
     "responseElements": {"ConsoleLogin": "Failure"}},
    {"eventName": "AssumeRole", "eventSource": "sts.amazonaws.com", "eventID": "2", "eventTime": "2026-09-13T06:14:02Z",
     "userIdentity": {"type": "AssumedRole", "principalId": "AROA:session-9", "accountId": "1",
                      "sessionContext": {"sessionIssuer": {"arn": "arn:aws:iam::1:role/deploy"}}}},
    {"eventName": "GetObject", "eventSource": "s3.amazonaws.com", "eventID": "3", "eventTime": "2026-09-13T06:14:02Z",
     "sourceIPAddress": "config.amazonaws.com", "errorCode": "AccessDenied", "errorMessage": "m" * 300,
     "userIdentity": {"type": "AWSService", "invokedBy": "config.amazonaws.com"}},
    {"eventName": "StopLogging", "eventSource": "cloudtrail.amazonaws.com", "eventID": "4", "eventTime": "2026-09-13T06:14:02Z",
     "userIdentity": {"type": "Root", "accountId": "1"}},
    {},
]


@pytest.mark.parametrize("shape", ["wrapper", "array", "single"])
def test_cloud_records(spark, shape):
    texts = {"wrapper": [json.dumps({"Records": RECORDS})], "array": [json.dumps(RECORDS)], "single": [json.dumps(r) for r in RECORDS]}[shape]
    records = cloud.cloud_records(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = {r["event_id"]: r for r in cloud.cloud_audit_to_events(records).collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert (got["1"]["event_outcome"], got["1"]["event_action"], got["1"]["event_reason"]) == ("failure", "user-login", "console login failed")
    assert (got["2"]["user_id"], got["2"]["labels"]["assumed_role"]) == ("role:deploy", "session-9")
    assert (got["3"]["source_ip"], got["3"]["service_name"], got["3"]["user_id"]) == (None, "config.amazonaws.com", "service:config.amazonaws.com")
    assert got["3"]["event_reason"] == "AccessDenied: " + "m" * 200 + "…"
    assert (got["4"]["event_action"], got["4"]["user_id"], got["4"]["user_name"]) == ("unknown", "root:1", "root")


def test_scalars(spark):
    row = spark.range(1).select(
        S.network_changed(F.lit("10.0.1.5"), F.lit("10.0.1.88")).alias("same"),
        S.network_changed(F.lit("::1"), F.lit("::2")).alias("v6"),
        S.network_changed(F.lit(None).cast("string"), F.lit("10.0.0.1")).alias("null"),
        S.is_private(F.lit("172.31.0.1")).alias("b"), S.is_private(F.lit("172.32.0.1")).alias("not_b"),
        in_cidr(F.lit("192.168.7.9"), "192.168.0.0/21").alias("inside"), in_cidr(F.lit("192.168.8.0"), "192.168.0.0/21").alias("outside"),
        S.decayed(F.lit(0.9), F.lit(21_600_000_000), 21600).alias("floor"), S.decayed(F.lit(40.0), F.lit(21_600_000_000), 21600).alias("half"),
        S.volume_ratio(F.lit(9), F.lit(0.5)).alias("thin"),
    ).first().asDict()
    assert row == {"same": False, "v6": True, "null": False, "b": True, "not_b": False, "inside": True, "outside": False, "floor": 0.0, "half": 20.0, "thin": 1.0}
    assert [S.seconds(t) for t in ("PT5M", "P7D", "PT1H30M", "30 minutes", 9)] == [300, 604800, 5400, 1800, 9]
    with pytest.raises(ValueError):
        S.seconds("soon")


def test_quality_of_an_empty_table(spark):
    none, dead = events(spark, []), spark.createDataFrame([], DEAD_LETTER)
    checks = {r["check_name"]: r for r in quality.quality_checks(none, dead, none, T0).collect()}
    assert len(checks) == 8
    assert not checks["freshness_seconds"]["passed"] and checks["freshness_seconds"]["observed"] == 999999
    assert checks["null_user_rate"]["passed"] and checks["null_user_rate"]["observed"] == 0
    assert not quality.blocking_checks(quality.quality_checks(none, dead, none, T0)).filter("blocks").count()


DAY = dt.date(2026, 9, 12)


def day_events(spark, n=50):
    midnight = -8 * 3600
    return events(spark, [event(midnight + i * 60, id=f"d{i}") for i in range(n)] + [event(midnight + 86400, id="next"), event(midnight - 1, id="before")])


def test_archive_day_edges(spark, tmp_path):
    path, ev = str(tmp_path), day_events(spark)
    assert lake.archive_day(ev, DAY, path)
    got = {r["event_id"] for r in lake.read_archive(spark, path).collect()}
    assert got == {f"d{i}" for i in range(50)}
    assert not lake.archive_day(ev, dt.date(2020, 1, 1), path)
    lake.archive_day(ev, dt.date(2026, 9, 13), path)
    lake.archive_day(ev, DAY, path)  # again: replaces, and leaves the other day alone
    assert lake.read_archive(spark, path).count() == 51
    inside = ev.filter(F.to_date("ts") >= F.lit(DAY))
    assert lake.verify_archive(inside, lake.read_archive(spark, path)).filter("not ok").count() == 0
    assert lake.verify_archive(ev, lake.read_archive(spark, path)).filter("not ok").count() == 1
    altered = inside.withColumn("user_id", F.when(F.col("event_id") == "d7", "x").otherwise(F.col("user_id")))
    assert lake.verify_archive(altered, lake.read_archive(spark, path)).filter("not ok").count() == 1


def test_compaction_keeps_every_row(spark, tmp_path):
    path, ev = str(tmp_path), day_events(spark)
    lake.write_days(ev.filter(F.to_date("ts") == F.lit(DAY)), path, rows_per_file=5)
    before = lake.partition_report(lake.read_archive(spark, path)).first()
    assert before["files"] >= 10
    assert lake.small_files_report(lake.read_archive(spark, path)).first()["compact"]
    result = lake.compact_day(spark, path, DAY)
    assert (result["after"], result["rows"]) == (1, 50)
    assert sorted(r["event_id"] for r in lake.read_archive(spark, path).collect()) == sorted(f"d{i}" for i in range(50))
    assert not lake.compact_day(spark, path, DAY)["compacted"]


def test_retention(spark, tmp_path):
    path = str(tmp_path)
    lake.write_days(day_events(spark), path)
    assert lake.apply_retention(spark, path, dt.date(2026, 10, 13), 30) == [dt.date(2026, 9, 11), DAY]
    assert lake.read_archive(spark, path).count() == 52
    lake.apply_retention(spark, path, dt.date(2026, 10, 13), 30, dry_run=False)
    assert lake.read_archive(spark, path).count() == 1
    with pytest.raises(ValueError):
        lake.apply_retention(spark, path, DAY, 0)


def test_daily_job(spark, tmp_path):
    ev, dead = day_events(spark), spark.createDataFrame([], DEAD_LETTER)
    newest = ev.agg(F.max("ts")).first()[0]
    checks = quality.quality_checks(ev, dead, ev.limit(0), F.lit(newest))
    done = lake.daily_maintenance(ev, checks, DAY, str(tmp_path), side_jobs={"rows": ev.count})
    assert done["archived"] and done["verified"] and done["rows"] == 52 and "freshness_seconds" not in done["liveness"]
    assert lake.daily_maintenance(ev, checks, dt.date(2020, 1, 1), str(tmp_path)) == {"liveness": done["liveness"], "archived": False}
    with pytest.raises(lake.QualityGateFailed, match="default_partition_rows"):
        lake.daily_maintenance(ev, quality.quality_checks(ev, dead, ev, at(0)), DAY, str(tmp_path))


def test_entry_point(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 20 and "alert_id" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
