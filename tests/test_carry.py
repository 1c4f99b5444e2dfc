"""State carried between runs equals one run over everything."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from secstream.functions.quantiles import exact_percentiles
from secstream.operators import carry
from secstream.operators.alerts import alert_positions, fold_positions
from secstream.operators.incidents import incident_history
from secstream.operators.risk import risk_scores, scored_firings
from secstream.plans.queries import _CARRIED_ALERTS, _INCIDENTS, _RISK

T0 = dt.datetime(2026, 1, 5, tzinfo=dt.timezone.utc)
REQUESTS = "entity_type string, entity_id string, at timestamp, seq string, to string, actor string, note string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def firing(spark, rows):
    """rows: (minute, id, entity, severity, score, stored alert)."""
    return spark.createDataFrame(
        [("user", e, at(m), i, "r1", s, float(x), st) for m, i, e, s, x, st in rows],
        "entity_type string, entity_id string, detected_at timestamp, alert_id string, rule_id string, severity string, score double, stored_id string",
    )


def requests(spark, rows):
    return spark.createDataFrame([("user", e, at(m), f"q{k}", to, "ann", f"note {k}") for k, (m, e, to) in enumerate(rows)], REQUESTS)


def test_a_resolved_incident_is_followed_by_a_second(spark):
    attached = firing(spark, [(0, "a", "u", "high", 60, "s1"), (5, "b", "u", "low", 70, "s1"), (30, "c", "u", "critical", 90, "s2"), (50, "d", "u", "medium", 95, "s2"), (1, "z", "v", "high", 50, "s3")])
    asked = requests(spark, [(6, "u", "triaged"), (7, "u", "contained"), (8, "u", "triaged"), (20, "u", "resolved"), (25, "u", "investigating"), (40, "u", "new"), (41, "u", "false_positive"), (60, "v", "resolved")])
    found, log = incident_history(attached, asked)
    rows = sorted((r.entity_id, r.opened_at.minute, r.status, r.severity, r.closed_at and r.closed_at.minute, r.resolution) for r in found.collect())
    assert rows == [("u", 0, "resolved", "high", 20, "note 3"), ("u", 30, "false_positive", "critical", 41, "note 6"), ("u", 50, "new", "medium", None, None), ("v", 1, "new", "high", None, None)]
    accepted = {r.seq: r.accepted for r in log.collect()}
    assert accepted == {"q0": True, "q1": True, "q2": False, "q3": True, "q4": False, "q5": False, "q6": True, "q7": False}


def plain(df):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.fixture(scope="module")
def whole(small):
    """What one run over all alerts gives, and the alerts and requests."""
    positions = alert_positions(small.alerts)
    scored = scored_firings(positions)
    return {
        "stored": plain(fold_positions(positions, small.now).select(*StructType.fromDDL(_CARRIED_ALERTS).fieldNames())),
        "risk": plain(risk_scores(scored).select(*StructType.fromDDL(_RISK).fieldNames())),
        "incidents": plain(incident_history(small.response.attached, small.entity_requests)[0].select(*StructType.fromDDL(_INCIDENTS).fieldNames())),
    }


def held(state):
    return {
        "stored": plain(state.stored.read(StructType.fromDDL(_CARRIED_ALERTS))),
        "risk": plain(state.risk.read(StructType.fromDDL(_RISK))),
        "incidents": plain(state.incidents.read(StructType.fromDDL(_INCIDENTS))),
    }


def test_runs_one_after_the_other_equal_one(spark, small, whole, tmp_path):
    """Two runs, of which the second is cut off in the middle, done again, and then repeated."""
    state = carry.Carried.at(spark, str(tmp_path))
    cut = small.alerts.agg(F.expr("percentile_approx(detected_at, 0.6)")).first()[0]
    parts = [[(df.filter(F.col(c) <= F.lit(cut)) if k == 0 else df.filter(F.col(c) > F.lit(cut))) for df, c in ((small.alerts, "detected_at"), (small.entity_requests, "at"))] for k in (0, 1)]
    assert carry.fold_run(*parts[0], state, "one", small.now)
    after_one = held(state)
    assert after_one != whole
    broken = carry.Carried.at(spark, str(tmp_path))
    broken.incidents.upsert = lambda rows, run: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        carry.fold_run(*parts[1], broken, "two", small.now)
    assert carry.fold_run(*parts[1], state, "two", small.now)
    assert held(state) == whole
    assert not carry.fold_run(*parts[1], state, "two", small.now)
    assert held(state) == whole


def test_the_newest_of_incidents_opened_at_one_instant_goes_on(spark):
    """The first firing opens one, a request of the same instant closes it, the next firing opens the second."""
    users = [f"u{k}" for k in range(12)]
    first = firing(spark, [(0, i, u, "high", 60, f"{u}-{i}") for u in users for i in ("a", "z")])
    later = firing(spark, [(9, "b", u, "critical", 80, f"{u}-z") for u in users])
    asked = [requests(spark, [(m, u, to) for u in users]) for m, to in ((0, "false_positive"), (5, "triaged"))]
    before, _ = incident_history(first, asked[0])
    assert before.count() == 24
    got, _ = incident_history(later, asked[1], before)
    whole, _ = incident_history(first.union(later), asked[0].union(asked[1]))
    assert plain(got.select(*whole.columns)) == plain(whole)


def test_upsert_rewrites_touched_keys_only(spark, tmp_path):
    table = carry.KeyedState(spark, str(tmp_path), ["k"], StructType.fromDDL("k bigint, v string"), buckets=4)
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    assert table.upsert(rows(0, 50, "a"), "1")
    before = set(table.table.live().folders)
    assert table.upsert(rows(7, 8, "b"), "2") and not table.upsert(rows(0, 50, "c"), "2")
    assert len(before - set(table.table.live().folders)) == 1
    assert {r.k: r.v for r in table.read().collect()} == {k: "b" if k == 7 else "a" for k in range(50)}
    assert {r.k for r in table.of(rows(45, 60, "x")).collect()} == {45, 46, 47, 48, 49}


@pytest.mark.parametrize("partitions", [1, 7])
def test_percentiles_equal_the_built_in(spark, partitions):
    rows = spark.range(5000).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 11 > 0, F.round(F.pow(F.col("id") * 7919 % 1000, 1.5), 1)).alias("v"))
    rows = rows.union(spark.range(4000).select(F.lit(0), F.lit(5.5))).union(spark.createDataFrame([(None, 1.0), (None, 2.0), (9, None)], "k int, v double"))
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.95, "e": 1.0}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.k: tuple(r)[1:] for r in exact_percentiles(rows, ["k"], "v", shares).collect()}
        total = tuple(exact_percentiles(rows, [], "v", shares).first())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {r.k: tuple(r)[1:] for r in rows.groupBy("k").agg(*[F.percentile("v", q) for q in shares.values()]).collect() if r[1] is not None}
    assert got == want and total == tuple(rows.agg(*[F.percentile("v", q) for q in shares.values()]).first())
