"""Places in one order over all rows, from range partitions and one offset row per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the 0-based place of each row in the order, which has to tell all rows apart."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition and place in it
    placed = ranged.withColumn("__part", F.shiftright(at, 33)).withColumn("__local", at.bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    counts = placed.groupBy("__part").agg(F.count("*").alias("c"))
    before = counts.select("__part", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__local")).drop("__part", "__local", "__before")


def ranked_within(df: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """df with the 0-based place of each row within its group, whose rows may be many: no task holds a whole group."""
    whole = ranked(df, F.col(group), *order, name="__rank")
    first = whole.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"))
    return whole.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__group", "__first")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group: group, n and for each name the value at that share of its order, interpolated between neighbours.

    Exact, from places in one order, so no task holds a group's values. Nulls are left out.
    """
    placed = ranked_within(df.where(F.col(value).isNotNull()).select(group, value), group, F.col(value), name="__r")
    n = placed.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n"))
    j = placed.join(n, F.col(group).eqNullSafe(F.col("__g")))
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    near = None
    for a in at.values():
        hit = (F.col("__r") == F.floor(a)) | (F.col("__r") == F.ceil(a))
        near = hit if near is None else near | hit
    pick = lambda a, edge: F.max(F.when(F.col("__r") == edge(a), F.col(value)))
    out = []
    for name, a in at.items():
        low, high, part = pick(a, F.floor), pick(a, F.ceil), F.max(a - F.floor(a))
        out.append((low + (high - low) * part).alias(name))
    return j.where(near).groupBy(group, "n").agg(*out)
