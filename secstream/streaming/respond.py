"""Alert folding and risk scores as streams over the alert table."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from secstream.functions.scalar import seconds, severity_name, severity_rank, severity_weight
from secstream.operators.risk import CAP, FLOOR, HALF_LIFE
from secstream.streaming.sources import reach_package


def stream_fold(alerts: DataFrame, suppression: str = "30 minutes", delay: str = "1 minute") -> DataFrame:
    """Stored alerts, emitted when a dedupe key has been quiet for the suppression window.

    Session windows merge partial sessions of each task, and none of the aggregates grows with
    the number of firings.
    """
    order = F.struct("detected_at", "alert_id")
    session = F.session_window("detected_at", suppression)
    return (
        alerts.withWatermark("detected_at", delay)
        .groupBy("dedupe_key", "rule_id", "entity_type", "entity_id", session)
        .agg(
            F.min_by("alert_id", order).alias("id"),
            F.min_by(F.struct("rule_name", "technique", "threshold", "window_start", "sample_event_ids"), order).alias("_first"),
            F.max_by("context", order).alias("context"),
            F.max("window_end").alias("window_end"),
            F.min("detected_at").alias("first_detected_at"),
            F.max("detected_at").alias("last_detected_at"),
            F.count("*").alias("occurrences"),
            F.max("observed").alias("observed"),
            severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        )
        .select("*", "_first.*")
        .drop("session_window", "_first")
    )


_SCORED = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("detected_us", T.LongType()),
        T.StructField("occurrence", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


_Scored = Row(*_SCORED.fieldNames())


class _Risk(StatefulProcessor):
    """Score of one entity, and how often each of its dedupe keys has fired in its open row.

    What no later firing can see goes: a dedupe key once the watermark is past its suppression window, the score
    once it has decayed under the floor. One timer an entity, for whatever goes next. Both are one state value, as
    every call to the state store is a message to another process: one read and one write a micro-batch.
    """

    def __init__(self, half_life_s: int, cap: float, suppression_us: int) -> None:
        self.half_life_s, self.cap, self.suppression_us = half_life_s, cap, suppression_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "score double, at_us bigint, timer_ms bigint, firings array<struct<dedupe_key:string,last_us:bigint,n:bigint>>")

    def _dies_ms(self, score: float, at_us: int) -> int:
        """When a score is under the floor: the first whole second at which the decay says so."""
        lasts = max(0.0, self.half_life_s * math.log2(score / FLOOR)) if score > 0 else 0.0
        return at_us // 1000 + (int(lasts) + 2) * 1000

    def _wake(self, score: float, at_us: int, before_ms: int, firings: dict) -> None:
        ends = [last // 1000 + self.suppression_us // 1000 + 1 for last, _ in firings.values()]
        timer = min([self._dies_ms(score, at_us), *ends])
        if timer != before_ms:
            if before_ms:
                self.handle.deleteTimer(before_ms)
            self.handle.registerTimer(timer)
        self.state.update((score, at_us, timer, [(name, *fired) for name, fired in firings.items()]))

    def _held(self) -> tuple[float, int | None, int, dict]:
        score, at_us, timer, firings = self.state.get() or (0.0, None, 0, [])
        return score, at_us, timer, {name: (last, n) for name, last, n in firings}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        score, at_us, timer, firings = self._held()
        for row in sorted(rows, key=lambda r: (r["at_us"], r["alert_id"])):
            last_us, n = firings.get(row["dedupe_key"], (None, 0))
            n = n + 1 if last_us is not None and row["at_us"] - last_us <= self.suppression_us else 1
            firings[row["dedupe_key"]] = row["at_us"], n
            elapsed = row["at_us"] - at_us if at_us is not None else 0
            if elapsed > 0:
                score *= 0.5 ** ((elapsed // 1_000_000) / self.half_life_s)
                score = score if score >= FLOOR else 0.0
            score = min(self.cap, score + row["weight"] / n**0.5)
            at_us = row["at_us"]
            yield _Scored(*key, row["alert_id"], row["at_us"], n, score)
        self._wake(score, at_us, timer, firings)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        score, at_us, _, firings = self._held()
        firings = {name: (last, n) for name, (last, n) in firings.items() if last + self.suppression_us >= now_ms * 1000}
        if self._dies_ms(score, at_us) <= now_ms:
            score = 0.0
        if score == 0.0 and not firings:
            self.state.clear()
        else:
            self._wake(score, at_us if score else now_ms * 1000, 0, firings)
        yield from ()

    def close(self) -> None:
        pass


def stream_risk(alerts: DataFrame, half_life: str = HALF_LIFE, cap: float = CAP, suppression: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Every firing with its occurrence number and the entity's score right after it.

    Firings later than ``delay`` are too late to count, as the state they would need may be gone.
    """
    reach_package(alerts.sparkSession)
    rows = alerts.withWatermark("detected_at", delay).select(
        "detected_at", "entity_type", "entity_id", "dedupe_key", "alert_id",
        F.unix_micros("detected_at").alias("at_us"), severity_weight(F.col("severity")).alias("weight"),
    )
    scored = rows.groupBy("entity_type", "entity_id").transformWithState(
        _Risk(seconds(half_life), float(cap), seconds(suppression) * 1_000_000), _SCORED, outputMode="Append", timeMode="EventTime"
    )
    return scored.withColumn("detected_at", F.timestamp_micros("detected_us")).drop("detected_us")
