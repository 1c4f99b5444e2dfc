"""Streams give what the batch operators give on the same events."""

import time

import pytest
from pyspark.sql import functions as F

from secstream.operators.alerts import alert_positions, fold_positions
from secstream.operators.baseline import user_baseline
from secstream.operators.ingest import ingest_batch, message_times, parse_events
from secstream.operators.lake import with_day
from secstream.operators.rules import PACKS, load_rules
from secstream.operators.sequence import baseline_deviation, impossible_travel, session_hijack
from secstream.operators.threshold import threshold_alerts, window_state
from secstream.operators.risk import scored_firings
from secstream.schema import ALERT_COLUMNS, DAY_PARTS, FLAT_COLUMNS
from secstream.streaming import detect, ingest, respond, sources

WEEKLY = load_rules(PACKS / "weekly")


def rows(df, *columns):
    columns = columns or df.columns
    return sorted(str(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def landed(small, tmp_path_factory):
    """The events as four files in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    events = small.ev.repartitionByRange(4, "ts").sortWithinPartitions("ts")
    stamped = events.select(*FLAT_COLUMNS)
    for number in range(4):
        bounds = [F.dayofmonth("ts") > 8 * number, F.dayofmonth("ts") <= 8 * number + 8]
        stamped.filter(bounds[0] & bounds[1]).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, stream, tmp_path, name, mode="append"):
    table = str(tmp_path / name)
    query = sources.start(
        stream, lambda batch, n: sources.write_batch(batch, table, n), str(tmp_path / f"{name}-cp"), mode=mode
    )
    query.awaitTermination()
    return spark.read.parquet(table).drop("batch")


def test_threshold_stream_equals_batch(spark, small, landed, tmp_path):
    stream = detect.stream_threshold(sources.file_events(spark, landed, 1), WEEKLY)
    got = drain(spark, stream, tmp_path, "threshold")
    want = threshold_alerts(small.ev, WEEKLY)
    assert want.count() > 20
    assert rows(got, *ALERT_COLUMNS) == rows(want, *ALERT_COLUMNS)


def test_window_counts_equal_batch(spark, small, landed, tmp_path):
    for rule in (WEEKLY[0], WEEKLY[1]):
        stream = detect.stream_window_counts(sources.file_events(spark, landed, 1), rule)
        got = drain(spark, stream, tmp_path, rule.id)
        state = window_state(small.ev, [rule])
        seen = F.col("distinct_values") if rule.distinct else F.col("events")
        newest = small.ev.agg(F.max("ts")).first()[0]
        full = state.filter(seen >= rule.threshold).select(
            "rule_id", "entity_id", F.timestamp_micros("window_us").alias("start"), seen.alias("observed")
        )
        closed = full.filter(F.col("start") + F.expr(f"INTERVAL {rule.window_seconds} SECONDS") < F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
        columns = ["rule_id", "entity_id", "start", "observed"]
        assert rows(got, *columns) == rows(closed, *columns)


def test_sequence_streams_equal_batch(spark, small, landed, tmp_path):
    travel = drain(spark, detect.stream_travel(sources.file_events(spark, landed, 1), "12 hours"), tmp_path, "travel")
    assert rows(travel, *ALERT_COLUMNS) == rows(impossible_travel(small.ev, "12 hours"), *ALERT_COLUMNS)
    hijack = drain(spark, detect.stream_hijack(sources.file_events(spark, landed, 1)), tmp_path, "hijack")
    want = session_hijack(small.ev)
    assert want.count() > 5
    assert rows(hijack, *ALERT_COLUMNS) == rows(want, *ALERT_COLUMNS)


def test_deviation_stream_equals_batch(spark, small, landed, tmp_path):
    base = str(tmp_path / "baseline")
    small.history.write.parquet(base)
    path = str(tmp_path / "deviations")
    detect.stream_deviation(sources.file_events(spark, landed, 1), base, path, str(tmp_path / "cp")).awaitTermination()
    want = baseline_deviation(small.ev, small.history)
    assert want.count() > 0
    assert rows(spark.read.parquet(path), *ALERT_COLUMNS) == rows(want, *ALERT_COLUMNS)


def test_ingest_stream_equals_batch_and_repeats_safely(spark, small, tmp_path):
    landing, events, dead = (str(tmp_path / n) for n in ("landing", "events", "dead"))
    small.messages.repartition(3).write.parquet(landing)
    ingest.stream_ingest(sources.file_messages(spark, landing, 1), events, dead, str(tmp_path / "cp")).awaitTermination()
    want = ingest_batch(small.messages)
    stored = ingest.stored_events(spark, events)
    assert rows(stored, "event_id", "ts") == rows(want.good, "event_id", "ts")
    assert spark.read.parquet(dead).count() == want.dead.count()
    # The same messages again, from a fresh checkpoint with other batch numbers: nothing new.
    again = sources.file_messages(spark, landing, 100).withColumn("arrived_at", F.col("arrived_at") + F.expr("INTERVAL 1 HOUR"))

    def replay(batch, number):
        found = ingest_batch(batch, ingest.stored_events(spark, events))
        assert found.good.count() == 0

    sources.start(again, replay, str(tmp_path / "cp2")).awaitTermination()


def test_dedupe_stream(spark, small, tmp_path):
    twice = str(tmp_path / "twice")
    small.ev.union(small.ev).coalesce(1).write.parquet(twice)
    got = drain(spark, ingest.stream_dedupe(sources.file_events(spark, twice), "40 days"), tmp_path, "once")
    assert got.count() == small.ev.count()


def test_risk_and_fold_streams_equal_batch(spark, small, tmp_path):
    landing = str(tmp_path / "alerts")
    alerts = small.alerts
    alerts.coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(alerts.schema).parquet(landing)
    got = drain(spark, respond.stream_risk(stream), tmp_path, "risk")
    positions = alert_positions(alerts)
    want = scored_firings(positions)
    columns = ["alert_id", "occurrence", "score"]
    assert rows(got.withColumn("score", F.round("score", 6)), *columns) == rows(want.withColumn("score", F.round("score", 6)), *columns)

    folded = drain(spark, respond.stream_fold(stream), tmp_path, "fold")
    newest = alerts.agg(F.max("detected_at")).first()[0]
    stored = fold_positions(positions, newest)
    closed = stored.filter(F.col("last_detected_at") < F.lit(newest) - F.expr("INTERVAL 31 MINUTES"))
    columns = ["id", "first_detected_at", "last_detected_at", "occurrences", "severity", "observed"]
    assert set(rows(closed, *columns)) <= set(rows(folded, *columns))
    assert closed.count() > 50


def test_quality_stream(spark, small, landed, tmp_path):
    """Checks look at the stored days around the batch; events dated far away count as the default partition's."""
    dead, stored, history = (str(tmp_path / n) for n in ("dead", "stored", "checks"))
    small.dead.write.parquet(dead)
    sources.write_batch(with_day(small.ev.select(*FLAT_COLUMNS)), stored, 0, DAY_PARTS)
    ingest.stream_quality(sources.file_events(spark, landed, 1), stored, dead, history, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(history).groupBy("check_name").count().count() == 8
    assert spark.read.parquet(history).filter("check_name = 'default_partition_rows' AND observed > 0").count() == 0
    strict = str(tmp_path / "strict")
    ingest.stream_quality(sources.file_events(spark, landed, 1), stored, dead, strict, str(tmp_path / "cp2"), expect_days=3).awaitTermination()
    assert spark.read.parquet(strict).filter("check_name = 'default_partition_rows' AND NOT passed").count() > 0


def test_state_of_the_risk_stream_goes(spark, small, tmp_path):
    """Entities whose score has decayed and whose keys are past suppression leave no state behind."""
    landing, alerts = str(tmp_path / "alerts"), small.alerts
    newest = alerts.agg(F.max("detected_at")).first()[0]
    shape = alerts.limit(1)
    rows = alerts.withColumn("entity_id", F.concat(F.lit("e"), F.col("entity_id")))
    for k, part in enumerate((rows, *(shape.withColumns({"detected_at": F.lit(newest) + F.expr(f"INTERVAL {d} DAYS"), "entity_id": F.lit(f"later{d}")}) for d in (10, 20, 30)))):
        part.coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)  # files are read by the second in which they were written
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    table = str(tmp_path / "scores")
    query = sources.start(respond.stream_risk(stream), lambda batch, n: sources.write_batch(batch, table, n), str(tmp_path / "risk-cp"))
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    entities = rows.select("entity_type", "entity_id").distinct().count()
    assert max(held) >= entities
    assert held[-1] < entities / 4


def test_stateless_event_times_equal_batch(spark, small, tmp_path):
    """Stream time goes on from one micro-batch to the next."""
    landing, times, state = (str(tmp_path / n) for n in ("landing", "times", "state"))
    lo, hi = small.messages.agg(F.min("offset"), F.max("offset")).first()
    for k in range(3):
        third = small.messages.filter(F.floor((F.col("offset") - lo) * 3 / F.lit(hi - lo + 1)) == k)
        third.coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    ingest.stream_times(sources.file_messages(spark, landing, 1), times, state, str(tmp_path / "cp")).awaitTermination()
    want = message_times(parse_events(small.messages))
    assert want.filter("time_from = 'stream'").count() > 0
    columns = ["partition", "offset", "time", "time_from"]
    assert rows(spark.read.parquet(times), *columns) == rows(want, *columns)
