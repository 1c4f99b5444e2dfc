"""The sliced forms equal the plain ones, whatever the slice width and however hot a key is."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from secstream.functions.ordered import any_overlap, running_before
from secstream.operators.alerts import alert_positions
from secstream.operators.incidents import MOVES, life_cycle
from secstream.operators.risk import scored_firings
from tests.helpers import T0, at

SEVERITY = {"info": 1, "low": 5, "medium": 15, "high": 40, "critical": 100}


@pytest.mark.parametrize("width", ["1 second", "10 minutes", "30 days"])
def test_running_before(spark, width):
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), at(rng.randrange(5000)), i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, v int")
    state = {"last": ("last", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "total": ("sum", F.col("v"))}
    got = running_before(df, ["k"], "ts", ["i"], state, width)
    w = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.last("v", True).over(w).alias("last"), F.max("v").over(w).alias("top"), F.min("v").over(w).alias("low"), F.sum("v").over(w).alias("total"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_any_overlap(spark):
    rng = random.Random(3)

    def spans(n, prefix):
        out = []
        for i in range(n):
            begin = rng.randrange(20000)
            out.append((rng.choice("aab"), f"{prefix}{i}", at(begin), at(begin + rng.randrange(400))))
        return out

    left, right = spans(120, "l"), spans(40, "r")
    schema = "k string, id string, s timestamp, e timestamp"
    got = any_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "s", "e", 60, "hit", "1 hour")
    slack = dt.timedelta(seconds=60)
    want = {l[1]: any(l[0] == r[0] and l[2] - r[3] <= slack and r[2] - l[3] <= slack for r in right) for l in left}
    assert {r["id"]: r["hit"] for r in got.collect()} == want
    assert 10 < sum(want.values()) < 110


def brute_risk(rows, half=21600, cap=300.0):
    out, score, last = {}, 0.0, None
    for at_s, name, severity, n in sorted(rows):
        elapsed = 0 if last is None else at_s - last
        if elapsed > 0 and score > 0:
            score *= 0.5 ** (int(elapsed) / half)
            score = 0.0 if score < 0.5 else score
        score = min(cap, score + SEVERITY[severity] / n**0.5)
        last, out[name] = at_s, score
    return out


@pytest.mark.parametrize("width", ["10 minutes", "1 hour", "400 days"])
def test_risk_in_slices_equals_one_walk(spark, width):
    rng = random.Random(11)
    cases = {
        "busy": [(rng.randrange(40000), rng.choice(list(SEVERITY)), rng.randrange(1, 5)) for _ in range(300)],
        "faint": [(60 * i + (900000 if i > 150 else 0), "info", 5 + i % 40) for i in range(300)],
        "rare": [(rng.randrange(40) * 86400, "medium", 1) for _ in range(30)],
        "mixed": [(rng.randrange(3_000_000), rng.choice(["info", "low"]), rng.randrange(1, 200)) for _ in range(300)],
    }
    rows, want = [], {}
    for entity, firings in cases.items():
        named = [(s, f"{entity}-{i:04d}", severity, n) for i, (s, severity, n) in enumerate(firings)]
        want |= brute_risk(named)
        rows += [("user", entity, name, at(s), severity, n, name, "r", "R", "T1") for s, name, severity, n in named]
    df = spark.createDataFrame(
        rows, "entity_type string, entity_id string, alert_id string, detected_at timestamp, severity string, occurrence long, stored_id string, rule_id string, rule_name string, technique string"
    )
    got = {r["alert_id"]: r["score"] for r in scored_firings(df, width=width).collect()}
    assert got.keys() == want.keys()
    for name, score in want.items():
        assert got[name] == pytest.approx(score, abs=1e-9), name


@pytest.mark.parametrize("width", ["1 minute", "400 days"])
def test_life_cycle_in_slices(spark, width):
    rng = random.Random(5)
    rows = [(k, at(rng.randrange(90000)), f"{i:03d}", rng.choice(list(MOVES))) for k in "ab" for i in range(60)]
    got = life_cycle(spark.createDataFrame(rows, "k string, at timestamp, seq string, to string"), "k", MOVES, "new", width)
    want = {}
    for k in "ab":
        state = "new"
        for _, when, seq, to in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            ok = to in MOVES[state]
            want[k, seq] = (state, to if ok else state, ok)
            state = to if ok else state
    assert {(r["k"], r["seq"]): (r["found"], r["left"], r["accepted"]) for r in got.collect()} == want


def test_positions_number_the_firings_of_a_row(spark):
    from tests.helpers import alert, alerts

    minutes = [0, 29, 59, 90, 91]
    got = alert_positions(alerts(spark, *[alert(60 * m) for m in minutes])).orderBy("detected_at").collect()
    assert [r["occurrence"] for r in got] == [1, 2, 3, 1, 2]
    assert T0.timestamp() == got[0]["detected_at"].timestamp()
