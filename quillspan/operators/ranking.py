"""Positions and ranks within groups, without giving a hot group to a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.runtime import maybe_broadcast, parallelism, small_enough, stage

#: Rows of one group that a single window task may sort.
WINDOW_ROWS = 200_000


def hot_groups(df: DataFrame, group: list[str], rows: int = WINDOW_ROWS) -> DataFrame:
    """Groups with more than ``rows`` rows; counts are combined before the shuffle."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows).select(*group)


def spread_positions(df: DataFrame, group: list[str], order: list[Column], out: str, weight: str | None = None) -> DataFrame:
    """1-based position of each row in its group by ``order`` (which must be a total order), for groups of any size.

    Rows are range-partitioned by group and order, numbered within each partition, and shifted by the rows that earlier
    partitions hold of the same group. With ``weight`` the running sum of that column, this row included, comes out.
    """
    spark = df.sparkSession
    n = max(parallelism(spark), 2)
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in group], *order).withColumn("_pid", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    amount = F.col(weight) if weight else F.lit(1)
    sums = ranged.groupBy(*group, "_pid").agg(F.sum(amount).alias("_held"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_pid").alias("_g_pid"),
        F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(amount).over(within))
    same = F.col("_pid") == F.col("_g_pid")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = local.join(maybe_broadcast(offsets), same)
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).drop("_local", "_offset", "_pid", "_g_pid", *[f"_g_{c}" for c in group])


def positions(df: DataFrame, group: list[str], order: list[Column], out: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Row number within each group by a total order. Groups over ``window_rows`` are numbered by :func:`spread_positions`, the others by a window.

    An empty table gives an empty table; a null group is a group of its own.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    plain = lambda d: d.withColumn(out, F.row_number().over(w).cast("long"))
    hot = hot_groups(df, group, window_rows)
    if small_enough(hot, 0):
        return plain(df)
    is_hot = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in group]
    on = is_hot[0]
    for c in is_hot[1:]:
        on = on & c
    hot = maybe_broadcast(stage(hot.select(*[F.col(c).alias(f"_h_{c}") for c in group]), "hot"))
    cool = df.join(hot, on, "left_anti")
    warm = df.join(hot, on, "left_semi")
    return plain(cool).unionByName(spread_positions(warm, group, order, out).withColumn(out, F.col(out).cast("long")))
