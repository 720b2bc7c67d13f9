"""Prefix sums over groups of any size.

A window over a hot group would run in one task. Here a group is cut into
hash buckets of bounded size; bucket totals (a small table) give each bucket's
offset, and the running sum inside a bucket is a window over that bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_sum(
    df: DataFrame, group: list[str], key: str, value: Column, out: str = "before",
    order: list[str] | None = None, rows_per_bucket: int = 50_000, seed: int = 7,
) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before this one in its group.

    The order within a group is (hash bucket of ``key``, ``order``, ``key``): fixed
    by the data, independent of partitioning. ``key`` must identify rows; rows with
    equal keys get an order among themselves from ``order``. Null groups are a group.
    """
    n = max(1, -(-df.count() // rows_per_bucket))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int")).withColumn("_value", value)
    totals = b.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
    up = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(g).alias(f"_o_{g}") for g in group), F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_total").over(up), F.lit(0)).alias("_offset"),
    )
    on = F.col("_bucket") == F.col("_o_bucket")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*(order or []), key).rowsBetween(W.unboundedPreceding, -1)
    return (
        b.join(offsets, on)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_offset", "_o_bucket", *(f"_o_{g}" for g in group))
    )


def running_sum(df: DataFrame, group: str, slot: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to and with this row in its group, by ``order``.

    ``slot`` must not fall along the order (an hour of the time, say). A window
    runs over each slot of a group, and one over the groups' slot totals, so that
    no task holds all rows of a hot group. Null groups are a group.
    """
    x = df.withColumn("_slot", slot)
    totals = x.groupBy(F.col(group).alias("_group"), F.col("_slot").alias("_at")).agg(F.sum(value).alias("_total"))
    before = W.partitionBy("_group").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_group", "_at", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(group, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_inside", F.sum(value).over(inside))
    x = x.join(totals, F.col(group).eqNullSafe(F.col("_group")) & F.col("_slot").eqNullSafe(F.col("_at")))
    return x.withColumn(out, F.col("_offset") + F.coalesce("_inside", F.lit(0))).drop("_slot", "_group", "_at", "_offset", "_inside")
