"""Folder tables whose live part is named by numbered manifests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from secstream.operators import lake, scoring
from secstream.sources.manifest import Manifest
from tests.test_ingest_and_lake import DAY, day_events

COLUMNS = "n long, p int"


def numbers(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id AS n", "CAST(id % 3 AS INT) AS p")


def ids(table, columns=COLUMNS):
    return sorted(r.n for r in table.read(columns).collect())


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    table = Manifest(spark, str(tmp_path))
    assert ids(table) == []
    assert table.append(numbers(spark, 0, 10), "a", ["p"]) and table.append(numbers(spark, 10, 20), "b", ["p"])
    assert not table.append(numbers(spark, 0, 10), "a", ["p"])
    assert ids(table) == list(range(20))


def test_readers_between_the_steps_see_every_row_once(spark, tmp_path):
    table = Manifest(spark, str(tmp_path))
    for k in range(4):
        table.append(numbers(spark, 10 * k, 10 * k + 10), str(k), ["p"])
    before = table.read(COLUMNS)  # opened on the old list
    old = [f for f, _ in table.live().folders]
    new = table.stage(before.repartition(1), ["p"])
    assert ids(table) == list(range(40))  # written, not published
    assert table.swap(old, new, "compaction")
    assert ids(table) == list(range(40)) and len(table.live().folders) == 3
    assert sorted(r.n for r in before.collect()) == list(range(40))
    assert not table.swap(old, new, "again")
    assert ids(table) == list(range(40))


def test_compaction_and_vacuum(spark, tmp_path):
    table = Manifest(spark, str(tmp_path))
    for k in range(5):
        table.append(numbers(spark, 10 * k, 10 * k + 10), str(k), ["p"])
    assert table.compact(COLUMNS, ["p"]) == 12
    assert table.compact(COLUMNS, ["p"]) == 0
    assert table.vacuum() == 5 and ids(table) == list(range(50))
    assert not table.append(numbers(spark, 0, 10), "0", ["p"])


def test_the_later_of_two_commits_sees_the_earlier(spark, tmp_path):
    table, asked = Manifest(spark, str(tmp_path)), []

    def late(now):
        asked.append(now.number)
        if len(asked) == 1:
            Manifest(spark, str(tmp_path)).append(numbers(spark, 0, 3), "other")
        return [*now.folders], {*now.runs, "mine"}

    assert table.commit(late) and asked == [0, 1]
    assert table.live().runs == {"other", "mine"} and ids(table, "n long") == [0, 1, 2]
    with pytest.raises(RuntimeError):
        table.commit(lambda now: (table.append(numbers(spark, 0, 1), str(now.number)), ([], set()))[1], attempts=2)


def test_a_stray_year_goes_to_the_default_partition_and_stays(spark, tmp_path):
    path, ev = str(tmp_path), day_events(spark)
    stray = ev.filter("event_id = 'd3'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 YEARS")).withColumn("event_id", F.lit("stray"))
    timeless = ev.filter("event_id = 'd4'").withColumn("ts", F.lit(None).cast("timestamp")).withColumn("event_id", F.lit("timeless"))
    expected = (DAY - dt.timedelta(days=5), DAY + dt.timedelta(days=5))
    for _ in range(2):
        lake.write_days(ev.union(stray).union(timeless), path, expected=expected, run="r1")
    found = lambda: sorted(r.event_id for r in lake.read_default(spark, path).collect())
    assert found() == ["stray", "timeless"]
    assert lake.read_archive(spark, path).count() == 52
    assert {d for d in lake.archived_days(spark, path)} == {DAY - dt.timedelta(days=1), DAY, DAY + dt.timedelta(days=1)}
    lake.write_days(stray, path, expected=expected, run="r2")
    assert found() == ["stray", "stray", "timeless"]
    lake.apply_retention(spark, path, dt.date(2030, 1, 1), 1, dry_run=False)
    assert lake.read_archive(spark, path).count() == 0 and found() == ["stray", "stray", "timeless"]


def test_score_history_takes_a_run_once(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01' AS scored_at, 6.0D AS window_hours, 'r' AS rule_id, CAST(NULL AS STRING) AS scenario, 1L AS true_positives, 0L AS false_positives, 0L AS false_negatives, 1.0D AS precision, CAST(NULL AS DOUBLE) AS recall, CAST(NULL AS DOUBLE) AS f1")
    path = str(tmp_path)
    assert scoring.append_score_history(rows, path) and not scoring.append_score_history(rows, path)
    later = rows.withColumn("scored_at", F.expr("timestamp'2026-01-02'"))
    assert scoring.append_score_history(later, path)
    assert scoring.read_score_history(spark, path).count() == 2
