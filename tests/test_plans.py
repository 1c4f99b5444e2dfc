"""What the physical plans must and must not contain, and every named query against plain SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from secstream.operators import baseline, hunting, lake, sequence
from secstream.plans.oracles import ORACLES
from secstream.plans.queries import QUERIES, all_queries
from tests.conftest import SMALL
from tests.helpers import plan
from tests.oracle_check import connect, difference, duck_rows, spark_rows

NO_ORACLE = {"storage_stats", "tier_comparison", "small_files_report"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_plain_sql():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    rows = spark_rows(df)
    if name in ORACLES:
        assert difference(rows, duck_rows(duck, ORACLES[name])) is None
    else:
        assert rows[1]


def test_baseline_is_one_aggregation(small):
    text = plan(baseline.user_baseline(small.ev, dt.datetime(2024, 1, 31), 7))
    assert "Join" not in text and text.count("Exchange") == 2  # by (user, source), then by user


def test_large_baselines_are_not_broadcast(spark, small):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1")
        df = sequence.baseline_deviation(small.ev, small.history)
        assert "BroadcastHashJoin" not in plan(df)
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_day_predicate_prunes_and_columns_are_pruned(small):
    day = dt.date(2024, 1, 10)
    df = small.archive.filter(lake.day_between(day, day)).select("event_id", "user_id")
    text = plan(df)
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    assert "ReadSchema: struct<event_id:string,user_id:string>" in text
    files = {r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect()}
    assert files and all("day=10" in f for f in files)


def test_look_back_prunes_days(small):
    df = hunting.brute_force_hunt(small.archive, dt.datetime(2024, 1, 30, 12), 1440, 1)
    scan = next(line for line in plan(df).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "make_date" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_time_predicate_reaches_the_scan(spark, small):
    text = plan(small.archive.filter("event_action = 'user-login'").select("ts"))
    assert "EqualTo(event_action,user-login)" in text
