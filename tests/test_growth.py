"""Work that grew faster than the data, or was done several times over."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from secstream.functions.scalar import text_map
from secstream.operators import carry
from secstream.operators import lake as L
from secstream.operators import threshold
from secstream.operators.incidents import incident_history, incident_transitions
from secstream.operators.risk import scored_firings
from secstream.operators.scoring import HISTORY, append_score_history, read_score_history
from secstream.plans.queries import QUERIES, Lab, lab
from secstream.sources import tables
from secstream.sources.manifest import Manifest
from secstream.streaming.respond import _Risk
from tests.helpers import at, plan
from tests.test_carry import firing, requests
from tests.test_scale import _Handle


def test_a_request_comes_back_once(spark):
    """Requests of one instant and number were joined to each other."""
    asked = spark.createDataFrame([("i", at(1), "q", "triaged", "ann", "one"), ("i", at(1), "q", "triaged", "bob", "two")], "incident_id string, at timestamp, seq string, to string, actor string, note string")
    opened = spark.createDataFrame([("i", "new", at(0))], "incident_id string, status string, updated_at timestamp")
    log = incident_transitions(opened, asked)[1]
    assert sorted((r.actor, r.note, r.found, r.accepted) for r in log.collect()) == [("ann", "one", "new", True), ("bob", "two", "triaged", False)]


def test_a_run_walks_the_incidents_once(spark, small, tmp_path, monkeypatch):
    calls, real = Counter(), carry.incident_history
    monkeypatch.setattr(carry, "incident_history", lambda *a: (calls.update(["walk"]), real(*a))[1])
    state = carry.Carried.at(spark, str(tmp_path))
    first, second = (small.alerts.filter(F.col("detected_at") <= "2024-01-15"), small.alerts.filter(F.col("detected_at") > "2024-01-15"))
    for name, part in (("one", first), ("two", second)):
        assert carry.fold_run(part, small.entity_requests.limit(0), state, name, small.now)
    assert calls["walk"] == 2


def test_many_slices_are_walked_as_one(spark):
    """Over three stretches of slices, the last of them not full."""
    rows = firing(spark, [(10 * m, f"a{m:04d}", "u", "medium", 0, "s") for m in range(300)])
    rows = rows.drop("score").withColumns({"rule_name": F.lit("R"), "technique": F.lit("T"), "occurrence": F.lit(1).cast("long")})
    got, whole = ({r.alert_id: round(r.score, 9) for r in scored_firings(rows, width=w).collect()} for w in ("5 minutes", "100 days"))
    assert len(got) == 300 and got == whole


def test_a_scoring_run_is_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda s: (seen.add(1), s)[1], "string").asNondeterministic()
    rows = spark.createDataFrame([(at(0), 1.0, "r", None, 1, 0, 0, 1.0, None, None)], HISTORY).withColumn("rule_id", count("rule_id"))
    assert append_score_history(rows, str(tmp_path)) and seen.value == 1
    assert read_score_history(spark, str(tmp_path)).count() == 1


def test_one_day_is_split_over_many_files(spark, monkeypatch):
    files, real = Counter(), L.compact_day

    def compact(spark, path, day):
        for folder, _ in Manifest(spark, path).live().folders:
            files[folder.endswith(L._folder_of(day))] += len(L._Files(spark, path).sizes(f"{path}/data/{folder}"))
        return real(spark, path, day)

    monkeypatch.setattr(L, "compact_day", compact)
    x = lab(spark, "/root/testdata/sf0.01")
    days = QUERIES["compact_day"](x).collect()
    assert sum(r["rows"] for r in days) == x.ev.count() and len(days) == 30
    assert files[True] >= 5 and files[False] <= 2 * 29


def test_a_batch_reads_and_writes_a_score_once():
    handle, now = _Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    handle.deleteTimer = lambda at_ms: None
    processor = _Risk(3600, 300.0, 1_800_000_000)
    processor.init(handle)
    rows = [{"at_us": n * 1_000_000, "alert_id": f"a{n}", "dedupe_key": f"k{n % 3}", "weight": 1.0} for n in range(40)]
    assert [s.occurrence for s in processor.handleInputRows(("user", "u"), iter(rows[:20]), now)] == [n // 3 + 1 for n in range(20)]
    assert [s.occurrence for s in processor.handleInputRows(("user", "u"), iter(rows[20:]), now)] == [n // 3 + 1 for n in range(20, 40)]
    assert [s.calls for s in handle.states] == [4]


def test_events_are_derived_once_and_dealt_out(spark, small):
    """Each scan parsed the JSON of the activity again, once for every condition, in as many tasks as there are row groups."""
    assert "get_json_object" not in plan(small.transition_requests) and "get_json_object" not in plan(small.events)
    dealt = tables.security_events(spark, small.sf_dir, dealt=True)
    assert "REPARTITION_BY_COL" in plan(dealt)
    assert small.events.columns == small.ev.drop("raw").columns
    told = [df.withColumn("run", F.col("labels")["run_id"]).drop("labels", "raw") for df in (small.ev, small.events)]
    assert small.events.count() == small.ev.count() and told[0].exceptAll(told[1]).isEmpty()


def test_a_text_map_stays_in_generated_code(spark):
    rows = spark.createDataFrame([(1, None), (None, "x"), (None, None)], "a int, b string")
    got = rows.select(text_map({"a": F.col("a"), "b": F.col("b")}).alias("m"))
    assert [r.m for r in got.collect()] == [{"a": "1"}, {"b": "x"}, {}] and got.schema["m"].dataType.simpleString() == "map<string,string>"
    assert "lambda" not in plan(got)


def test_alerts_that_are_stored_are_not_written_again(small, monkeypatch):
    from secstream.plans import detection

    names, real = [], detection.materialise
    monkeypatch.setattr(detection, "materialise", lambda df, name: (names.append(name), real(df, name))[1])
    detection.respond(small.alerts, small.now, stored=True)
    assert names == ["positions", "scored"]


def test_a_request_comes_back_once_in_a_history(spark):
    attached = firing(spark, [(0, "a", "u", "high", 60, "s1")])
    asked = requests(spark, [(5, "u", "triaged"), (5, "u", "contained")]).withColumn("seq", F.lit("q"))
    found, log = incident_history(attached, asked)
    assert sorted((r.to, r.found, r.left) for r in log.collect()) == [("contained", "new", "new"), ("triaged", "new", "triaged")]
    assert [(r.entity_id, r.status) for r in found.collect()] == [("u", "triaged")]


def test_a_request_for_nobody_comes_back(spark):
    asked = requests(spark, [(5, "u", "triaged"), (6, None, "triaged")])
    log = incident_history(firing(spark, [(0, "a", "u", "high", 60, "s1")]), asked)[1]
    assert sorted((r.seq, r.found, r.left, r.accepted, r.incident_id is None) for r in log.collect()) == [("q0", "new", "triaged", True, False), ("q1", "none", "none", False, True)]


def test_incidents_and_actions_are_worked_out_once(small):
    for written, lazy in ((small.incidents, small.response.incidents), (small.actions, small.response.actions)):
        assert "Aggregate" in plan(lazy) and "Aggregate" not in plan(written)
        assert lazy.exceptAll(written).isEmpty() and written.count() == lazy.count()


@pytest.mark.parametrize("name", ["propose_actions", "outstanding_action_filter"])
def test_proposals_read_no_evidence(spark, small, monkeypatch, name):
    """Evidence, which no proposal shows, was put together for every alert."""
    monkeypatch.setattr(threshold, "_evidence", lambda seen: pytest.fail("evidence was put together"))
    got, key = QUERIES[name](Lab(spark, small.sf_dir)), ["action", "target_type", "target_id"]
    monkeypatch.undo()
    want = small.response.actions
    if name != "propose_actions":
        want = want.filter("action <> 'disable_account' OR ascii(substring(target_id, 7, 1)) % 2 = 1")
    assert got.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and set(key) <= set(got.columns)
