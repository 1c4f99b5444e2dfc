"""A decaying risk score per entity.

Each firing first lets the score decay, then adds its weight, and the sum is capped. Together with
the floor (a residue under one half is zero) this is not a plain sum, so firings must be taken in
order. The effect of a whole run of firings on an incoming score ``u`` still has a closed form::

    u < merge ? lowest : min(cap, slope * u + offset)

``lowest`` is where a score of zero ends; every score below ``merge`` is floored somewhere along
the run and from there on follows it. So a run is described by five numbers, hot entities can be
cut into time slices, and only the slice descriptions are walked in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secstream.functions.ordered import sliced_fold, stepwise
from secstream.functions.scalar import (
    as_time,
    at_most,
    decayed,
    gap_micros,
    seconds,
    severity_weight,
)

# Half-life, cap, floor.
HALF_LIFE = "6 hours"
CAP = 300
FLOOR = 0.5


def firing_weight() -> Column:
    """Full weight for the first occurrence, then divided by the root of the occurrence."""
    return severity_weight(F.col("severity")) / F.sqrt(F.col("occurrence").cast("double"))


def _summary(cap: float, half_life_s: int):
    def capped(value: Column) -> Column:
        return F.least(F.lit(cap), value)

    def extend(run: Column, step: Column) -> Column:
        elapsed = step["at_us"] - run["last_us"]
        moved = elapsed > 0
        kept = F.pow(F.lit(0.5), F.floor(elapsed / F.lit(1_000_000)) / F.lit(float(half_life_s)))
        keep = F.when(moved, kept).otherwise(1.0)
        drowned = F.when(keep * run["cap"] < FLOOR, F.lit(float("inf"))).otherwise(
            F.greatest(run["merge"], (F.lit(FLOOR) / keep - run["offset"]) / run["slope"])
        )
        return F.struct(
            run["first_us"].alias("first_us"),
            step["at_us"].alias("last_us"),
            F.when(moved, drowned).otherwise(run["merge"]).alias("merge"),
            capped(decayed(run["lowest"], elapsed, half_life_s) + step["weight"]).alias("lowest"),
            (run["slope"] * keep).alias("slope"),
            (run["offset"] * keep + step["weight"]).alias("offset"),
            capped(run["cap"] * keep + step["weight"]).alias("cap"),
        )

    def summarise(steps: Column) -> Column:
        first = F.element_at(steps, 1)
        start = F.struct(
            first["at_us"].alias("first_us"),
            first["at_us"].alias("last_us"),
            F.lit(0.0).alias("merge"),
            capped(first["weight"]).alias("lowest"),
            F.lit(1.0).alias("slope"),
            first["weight"].alias("offset"),
            F.lit(cap).alias("cap"),
        )
        return F.aggregate(F.slice(steps, 2, 1 << 30), start, extend)

    return summarise


def _advance(half_life_s: int):
    def advance(state: Column, run: Column) -> Column:
        waited = run["first_us"] - F.coalesce(state["at_us"], run["first_us"])
        entering = decayed(state["score"], waited, half_life_s)
        leaving = F.when(entering < run["merge"], run["lowest"]).otherwise(
            F.least(run["cap"], run["slope"] * entering + run["offset"])
        )
        return F.struct(leaving.alias("score"), run["last_us"].alias("at_us"))

    return advance


def scored_firings(
    positions: DataFrame, half_life: str = HALF_LIFE, cap: float = CAP, width: str = "5 minutes", start: DataFrame | None = None
) -> DataFrame:
    """Every firing with the entity's score right after it.

    ``start`` has the scores that earlier batches left (``entity_type, entity_id, score, updated_at``). A score from
    nothing is its first weight, so each stands in front of its entity as a firing with that weight.
    """
    half, top = seconds(half_life), float(cap)
    passed = ["stored_id", "rule_id", "rule_name", "technique", "severity", "occurrence"]

    def step(state, now_us, weight):
        score, at_us = state
        elapsed = 0 if at_us is None or at_us != at_us else now_us - int(at_us)
        if elapsed > 0 and score > 0:
            score *= 0.5 ** ((elapsed // 1_000_000) / half)
            if score < FLOOR:
                score = 0.0
        score = min(top, max(0.0, score) + weight)
        return (score, now_us), score

    replay_scores = stepwise(step, "double")

    def replay(state: Column, steps: Column) -> Column:
        return F.transform(
            F.arrays_zip(steps.alias("s"), replay_scores(state, steps["at_us"], steps["weight"]).alias("r")),
            lambda pair: F.struct(
                F.timestamp_micros(pair["s"]["at_us"]).alias("detected_at"),
                *[pair["s"][c].alias(c) for c in ("alert_id", *passed)],
                pair["r"].alias("score"),
            ),
        )

    rows = positions.withColumn("weight", firing_weight())
    if start is not None:
        heads = start.select("entity_type", "entity_id", F.col("updated_at").alias("detected_at"), F.lit("").alias("alert_id"), F.col("score").alias("weight"))
        rows = rows.unionByName(heads, allowMissingColumns=True)
    scored = sliced_fold(
        rows,
        ["entity_type", "entity_id"],
        "detected_at",
        ["alert_id"],
        ["weight", *passed],
        _summary(top, half),
        F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("at_us")),
        _advance(half),
        replay,
        width,
    )
    return scored if start is None else scored.filter("alert_id <> ''")


def risk_scores(scored: DataFrame) -> DataFrame:
    """Stored score per entity: latest, and the peak with the first time it was reached."""
    order = F.struct("detected_at", "alert_id")
    return scored.groupBy("entity_type", "entity_id").agg(
        F.max_by("score", order).alias("score"),
        F.max("score").alias("peak_score"),
        F.max("detected_at").alias("updated_at"),
        F.max_by("detected_at", F.struct("score", -F.unix_micros("detected_at"))).alias("peaked_at"),
    )


def top_risk(risk: DataFrame, as_of, limit: int = 20, half_life: str = HALF_LIFE) -> DataFrame:
    """Highest current risk: decay to ``as_of`` first, then rank."""
    live = decayed(F.col("score"), gap_micros(as_time(as_of), F.col("updated_at")), seconds(half_life))
    return (
        risk.filter("score > 0")
        .select(
            "entity_type",
            "entity_id",
            F.round(live, 1).alias("current_score"),
            F.round("score", 1).alias("stored_score"),
            F.round("peak_score", 1).alias("peak_score"),
            F.col("updated_at").alias("last_alert_at"),
            "peaked_at",
        )
        .filter("current_score > 0")
        .orderBy(F.desc("current_score"), "entity_type", "entity_id")
        .transform(at_most, limit)
    )
