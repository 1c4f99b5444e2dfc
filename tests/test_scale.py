"""Work of streams and carried state grows with the data in bounded tasks."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from secstream.plans import queries
from secstream.sources import tables
from secstream.streaming import detect
from tests import oracle_check


class _Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


class _Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def getValueState(self, *_):
        self.states.append(_Value())
        return self.states[-1]

    def registerTimer(self, at_ms):
        self.timers.append(at_ms)


def _hit(n, window=0, threshold=3):
    return {"rule_id": "r", "window_us": window, "closes_us": window + 1_000_000, "delay_us": 0, "ts_us": window + n, "event_id": f"e{n}",
            "threshold": threshold, "counted": None, "distinct_field": None, "facts": [{"name": "ip", "item": f"i{n}"}]}


def test_a_batch_reads_and_writes_an_entity_once():
    """Every call to the state store is a message to another process."""
    handle, now = _Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    processor = detect._Crossing()
    processor.init(handle)
    rows = [_hit(n, w * 2_000_000) for w in range(5) for n in range(2)]
    assert list(processor.handleInputRows(("u",), iter(rows), now)) == []
    assert [s.calls for s in handle.states] == [2] and len(handle.timers) == 5
    fired = list(processor.handleInputRows(("u",), iter([_hit(n, 2_000_000) for n in range(2, 40)]), now))
    assert [(f.entity_id, f.window_us, f.event_id, f.samples, f.context["ip"]) for f in fired] == [("u", 2_000_000, "e2", ["e0", "e1", "e2"], "i0, i1, i2")]
    assert [s.calls for s in handle.states] == [4] and len(handle.timers) == 5
    assert list(processor.handleInputRows(("u",), iter([_hit(50, 2_000_000)]), now)) == []
    list(processor.handleExpiredTimer(("u",), now, SimpleNamespace(getExpiryTimeInMs=lambda: 4_000)))
    assert [w[1] for w in handle.states[0].value[0]] == [4_000_000, 6_000_000, 8_000_000]


def test_landed_stretches_take_files_by_their_rows(spark, small, monkeypatch):
    """All stretches have as many files as the largest needs, so a trigger takes a stretch."""
    monkeypatch.setattr(queries, "ROWS_A_FILE", 50)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    n = F.col("id")
    minutes = F.when(n < 800, n).when(n < 802, n + 900).otherwise(n + 2000)  # a stretch with two rows
    rows = spark.range(2000).select("id", (F.lit(start) + minutes * F.expr("INTERVAL 1 MINUTE")).alias("at"))
    landed = queries._landed(small, rows, "at", "test-landed")
    back = spark.read.parquet(landed.path).select("id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    assert back.count() == 2000 and landed.per_stretch >= 16
    files = back.groupBy("f").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.max("m").alias("m")).orderBy("m").collect()
    assert len(files) % landed.per_stretch == 0 and max(f.n for f in files) < 200
    batches = [files[k : k + landed.per_stretch] for k in range(0, len(files), landed.per_stretch)]
    assert all(max(f.hi for f in a) < min(f.lo for f in b) for a, b in zip(batches, batches[1:], strict=False))


def test_a_batch_is_counted_once_whatever_becomes_of_the_cache(spark, small, monkeypatch):
    """Two executors may compute one cached partition at the same time; without a cache every use computes it."""
    monkeypatch.setattr(type(small.ev), "persist", lambda df, *_: df)
    got = queries.QUERIES["stream_batch_metrics"](small).first()
    assert got.received == small.messages.count() and got.rejected == small.dead.count()


def test_dead_letters_after_the_moment_of_the_checks_do_not_count(spark, tmp_path):
    """The newest event is a cut message, and it arrives after the moment that the checks are made for."""
    from tests.conftest import SMALL

    con = oracle_check.connect(SMALL)
    con.execute(f"COPY (SELECT * FROM events UNION ALL SELECT 1000000, max(ts) + INTERVAL 1 SECOND, 1, 'view', 50.0, '{{\"k\": 50}}' FROM events) TO '{tmp_path}/events.parquet'")
    for table in oracle_check.TABLES:
        if table != "events":
            (tmp_path / f"{table}.parquet").symlink_to(f"{SMALL}/{table}.parquet")
    assert tables.messages(spark, str(tmp_path)).filter("offset = 2000000 AND length(value) = 40").count() == 1
    got = oracle_check.spark_rows(queries.all_queries()["quality_checks"](spark, str(tmp_path)))
    assert oracle_check.difference(got, oracle_check.duck_rows(oracle_check.connect(str(tmp_path)), oracle_sql()["quality_checks"])) is None
