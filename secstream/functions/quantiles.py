"""Exact percentiles without one task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secstream.session import materialise


def exact_percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and one column for each of ``shares``, as ``percentile`` gives them; nulls do not count.

    Equal values are counted in front of the shuffle. The counts are range-partitioned by key and value, so a large
    group spreads; totals of the ranges, one row per key and range, say how many values lie in front of each, and
    running counts inside a range find the two neighbours of every rank.
    """
    value = F.col(column).cast("double")
    counts = df.select(*keys, value.alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    laid = materialise(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "value-counts")
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    totals = laid.groupBy(*keys, "_range").agg(F.sum("_n").alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy("_range")
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_total").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_total").over(Window.partitionBy(*keys)).alias("_all"),
    )
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = laid.withColumn("_upto", F.sum("_n").over(inside)).join(totals, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    found = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("_all") - 1)
        found += [
            F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_v"))).alias(f"_low_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_v"))).alias(f"_high_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_part_{name}"),
        ]
    out = placed.groupBy(*keys).agg(*found)
    # the same arithmetic as the built-in function: each neighbour times its weight
    weighed = {n: F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise((1 - F.col(f"_part_{n}")) * F.col(f"_low_{n}") + F.col(f"_part_{n}") * F.col(f"_high_{n}")) for n in shares}
    return out.select(*keys, *[c.alias(n) for n, c in weighed.items()])
