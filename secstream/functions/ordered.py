"""Order-dependent logic per key that never gathers one key in one task.

A plain window partitioned by user or by source address puts all rows of that key into one task,
which fails when a single key holds a large share of the table. The helpers here cut every key
into time slices. What crosses a slice border is a small aggregate per slice, combined on the map
side; only those aggregates (at most one row per key and slice) are put in order per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secstream.functions.scalar import micros
from secstream.session import materialise

SLICE = "_slice"
_HEAD = "_head"
#: Slices that are walked into one array, before it is put behind those of the earlier stretches.
STRETCH = 128


def slice_of(at: str, width: str) -> Column:
    return F.floor(F.unix_micros(F.col(at)) / F.lit(micros(width)))


def _summarise(kind: str, column: str, order: Column) -> Column:
    """The slice's contribution to what later slices see."""
    if kind == "last":
        present = F.when(F.col(column).isNotNull(), order)
        return F.max_by(column, present)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](column)


def _running(kind: str, column: str, window) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](column).over(window)


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: Sequence[str],
    state: dict[str, tuple[str, Column]],
    width: str = "10 minutes",
) -> DataFrame:
    """Add, per row, a running aggregate over the rows of its key that come before it.

    ``state`` maps a new column to ``(kind, expression)`` where kind is ``last`` (latest non-null
    value), ``max``, ``min`` or ``sum``. Order is ``(at, *tie)``. The result equals a window
    ``partitionBy(keys).orderBy(at, *tie).rowsBetween(unbounded, -1)``, but a task only ever holds
    one slice of ``width`` of one key. ``df`` is read twice, so materialise an expensive input.
    """
    keys, tie = list(keys), list(tie)
    rows = df.withColumn(SLICE, slice_of(at, width))
    for name, (_, expression) in state.items():
        rows = rows.withColumn(f"_in_{name}", expression)
    order = F.struct(at, *tie)

    per_slice = rows.groupBy(*keys, SLICE).agg(
        *[_summarise(kind, f"_in_{name}", order).alias(f"_in_{name}") for name, (kind, _) in state.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    heads = per_slice.select(
        *keys,
        SLICE,
        *[_running(kind, f"_in_{name}", earlier).alias(f"_in_{name}") for name, (kind, _) in state.items()],
        F.lit(True).alias(_HEAD),
    )

    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(F.col(_HEAD).desc(), at, *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    merged = rows.withColumn(_HEAD, F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return (
        merged.select(
            *df.columns,
            _HEAD,
            *[_running(kind, f"_in_{name}", inside).alias(name) for name, (kind, _) in state.items()],
        )
        .filter(~F.col(_HEAD))
        .drop(_HEAD)
    )


def sliced_fold(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: Sequence[str],
    payload: Sequence[str],
    summarise: Callable[[Column], Column],
    initial: Column,
    advance: Callable[[Column, Column], Column],
    replay: Callable[[Column, Column], Column],
    width: str = "1 hour",
) -> DataFrame:
    """Fold the rows of each key in order, for folds that are not plain running aggregates.

    1. Each slice of a key becomes a sorted array of steps; ``summarise(steps)`` describes what
       the slice does to any incoming state.
    2. Per key, ``advance(state, summary)`` walks over the slice summaries (one per slice, not one
       per row) and yields the state that enters each slice. Appending copies an array, so the walk goes in
       stretches: a key's many slices would cost their square.
    3. ``replay(state, steps)`` runs each slice from its incoming state and returns one output
       struct per step, in parallel over slices.

    Returns ``keys`` plus the fields of the structs that ``replay`` returns.
    """
    keys, seen = list(keys), f"array<struct<slice:bigint,state:{_type_of(df, initial)}>>"
    step = F.struct(F.unix_micros(at).alias("at_us"), *tie, *[c for c in payload if c not in tie])
    slices = (
        df.withColumn(SLICE, slice_of(at, width))
        .groupBy(*keys, SLICE)
        .agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    )
    summaries = slices.select(
        *keys, F.struct(F.col(SLICE).alias("slice"), summarise(F.col("_steps")).alias("summary")).alias("_sum")
    )
    walked = (
        summaries.groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_sum")).alias("_sums"))
        .withColumn(
            "_entering",
            F.flatten(
                F.aggregate(
                    F.transform(F.sequence(F.lit(0), F.floor((F.size("_sums") - 1) / F.lit(STRETCH)).cast("int")), lambda i: F.slice("_sums", i * STRETCH + 1, STRETCH)),
                    F.struct(initial.alias("state"), F.array().cast(f"array<{seen}>").alias("seen")),
                    lambda acc, stretch: F.aggregate(
                        stretch,
                        F.struct(acc["state"].alias("state"), F.array().cast(seen).alias("last"), acc["seen"].alias("seen")),
                        lambda inner, item: F.struct(
                            advance(inner["state"], item["summary"]).alias("state"),
                            F.array_append(inner["last"], F.struct(item["slice"].alias("slice"), inner["state"].alias("state"))).alias("last"),
                            inner["seen"].alias("seen"),
                        ),
                        lambda inner: F.struct(inner["state"].alias("state"), F.array_append(inner["seen"], inner["last"]).alias("seen")),
                    ),
                    lambda acc: acc["seen"],
                )
            ),
        )
        .select(*keys, F.explode("_entering").alias("_entry"))
        .select(*keys, F.col("_entry.slice").alias(SLICE), F.col("_entry.state").alias("_state"))
    )
    return (
        slices.join(walked, [*keys, SLICE])
        .select(*keys, replay(F.col("_state"), F.col("_steps")).alias("_out"))
        .select(*keys, F.inline("_out"))
    )


def _type_of(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


def any_overlap(
    probe: DataFrame,
    build: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tolerance: str | int,
    flag: str,
    width: str = "1 hour",
) -> DataFrame:
    """Flag each ``probe`` interval that overlaps some ``build`` interval of the same key.

    Intervals ``[start, end]`` overlap when neither begins more than ``tolerance`` after the other
    ended. An interval joins no other interval: among the build intervals that begin early enough,
    it is enough to know the latest end, which is a running maximum over both sides in time order.
    """
    slack = F.lit(micros(tolerance))
    keys = list(keys)
    payload = [c for c in probe.columns if c not in keys]
    asks = probe.select(
        *keys,
        F.timestamp_micros(F.unix_micros(end) + slack).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("timestamp").alias("_ends"),
        F.struct(*payload).alias("_row"),
    )
    told = build.select(
        *keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(end).alias("_ends")
    )
    both = materialise(asks.unionByName(told, allowMissingColumns=True), "intervals")
    seen = running_before(both, keys, "_at", ["_side"], {"_latest": ("max", F.col("_ends"))}, width)
    hit = F.unix_micros("_latest") >= F.unix_micros(F.col("_row")[start]) - slack
    return seen.filter("_side = 1").select(
        *keys, "_row.*", F.coalesce(hit, F.lit(False)).alias(flag)
    )


def stepwise(step: Callable, out: str):
    """A vectorised column function ``(start, *steps) -> array<out>`` that applies ``step`` in order.

    ``step(state, *row)`` returns ``(state, output)``; each of ``steps`` is an array with one value per step, as an
    array of structs would become a dict per step. For folds whose every intermediate result is wanted: growing an
    array inside an SQL ``aggregate`` copies it at each step.
    """
    @F.pandas_udf(f"array<{out}>")
    def run(start: pd.DataFrame, *steps: pd.Series) -> pd.Series:
        results = []
        for first, *columns in zip(start.itertuples(index=False, name=None), *steps):
            state, outputs = first, []
            for row in zip(*[values.tolist() for values in columns]):
                state, output = step(state, *row)
                outputs.append(output)
            results.append(outputs)
        return pd.Series(results)

    return run
