"""One ranking from several differently scaled scores: median rank aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.ranking import WINDOW_ROWS, positions, spread_positions
from quillspan.runtime import maybe_broadcast, small_enough, stage


def _weighted_median(pairs: Column) -> Column:
    """Weighted median of an array of (rank, weight), the middle of both where the halves are equal."""
    ordered = F.array_sort(pairs)
    half = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["w"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["w"]
        return F.struct(
            total.alias("sum"),
            F.coalesce(acc["low"], F.when(total >= half, x["r"])).alias("low"),
            F.coalesce(acc["high"], F.when(total > half, x["r"])).alias("high"),
        )

    return F.aggregate(ordered, start, step, lambda a: (a["low"] + a["high"]) / 2)


def _window_ranks(df: DataFrame, group: list[str], scores: list[str]) -> DataFrame:
    for s in scores:
        same = Window.partitionBy(*group, s)
        df = df.withColumn(f"_r_{s}", F.rank().over(Window.partitionBy(*group).orderBy(F.col(s).desc_nulls_last())) + (F.count(F.lit(1)).over(same) - 1) / 2)
        df = df.withColumn(f"_r_{s}", F.when(F.count(s).over(Window.partitionBy(*group)) > 0, F.col(f"_r_{s}")))
    return df


def _spread_ranks(df: DataFrame, group: list[str], scores: list[str]) -> DataFrame:
    """The same ranks for groups too large for one task: values are counted first, then numbered across partitions."""
    for s in scores:
        values = df.where(F.col(s).isNotNull()).groupBy(*group, s).agg(F.count(F.lit(1)).alias("_n"))
        upto = spread_positions(values, group, [F.col(s).desc()], "_upto", weight="_n")
        ranks = upto.select(*[F.col(c).alias(f"_k_{c}") for c in group], F.col(s).alias("_k_score"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_known"))
        sizes = df.groupBy(*group).agg(F.count(s).alias("_some"), F.count(F.lit(1))
            .alias("_all")).select(*[F.col(c).alias(f"_z_{c}") for c in group], "_some", "_all")
        on, onto = F.col(s) == F.col("_k_score"), F.lit(True)
        for c in group:
            on, onto = on & F.col(c).eqNullSafe(F.col(f"_k_{c}")), onto & F.col(c).eqNullSafe(F.col(f"_z_{c}"))
        found = df.where(F.col(s).isNotNull()).join(ranks, on).withColumn(f"_r_{s}", F.col("_known")).drop("_known", "_k_score", *[f"_k_{c}" for c in group])
        missing = df.where(F.col(s).isNull()).join(maybe_broadcast(sizes), onto)
        missing = missing.withColumn(f"_r_{s}", F.when(F.col("_some") > 0,
            F.col("_some") + (F.col("_all") - F.col("_some") + 1) / 2)).drop("_some", "_all", *[f"_z_{c}" for c in group])
        df = stage(found.unionByName(missing), "ranks")
    return df


def fuse_scores(df: DataFrame, group: list[str], item: str, scores: list[str], weights: dict[str, float] | None = None,
    window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One ranking of the items of each group, in which only their order in each score counts.

    Returns ``group, item, rank_<score>..., median_rank, mean_rank, position``; ``position`` 1 is best. Higher scores are
    better; equal scores share the mean of their ranks. A null or NaN score stands last (all of them share one rank); a
    score that a whole group lacks has no say there, and a group without any score is ordered by its item. An item that is
    repeated counts once, with its best value of each score; null items are dropped. Groups beyond ``window_rows`` are ranked across
    partitions. Other columns of ``df`` are ignored, so their names can't clash; an empty table gives an empty ranking.
    """
    weights = weights or {}
    clean = df.where(F.col(item).isNotNull()).groupBy(*group,
        item).agg(*[F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores])
    sizes = clean.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > window_rows).select(*group)
    if small_enough(hot, 0):
        ranked = _window_ranks(clean, group, scores)
    else:
        clean = stage(clean, "scores")
        hot = maybe_broadcast(stage(hot.select(*[F.col(c).alias(f"_h_{c}") for c in group]), "hot"))
        on = F.lit(True)
        for c in group:
            on = on & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
        ranked = _window_ranks(clean.join(hot, on, "left_anti"), group, scores).unionByName(_spread_ranks(clean.join(hot, on, "left_semi"), group, scores))
        ranked = stage(ranked, "ranked")
    pairs = F.filter(F.array(*[F.struct(F.col(f"_r_{s}").cast("double").alias("r"), F.lit(float(weights.get(s, 1))).alias("w"))
        for s in scores]), lambda x: x["r"].isNotNull())
    fused = ranked.withColumn("_pairs", pairs).select(
        *group,
        item,
        *[F.col(f"_r_{s}").cast("double").alias(f"rank_{s}") for s in scores],
        _weighted_median(F.col("_pairs")).alias("median_rank"),
        F.try_divide(F.aggregate("_pairs", F.lit(0.0), lambda a, x: a + x["r"] * x["w"]),
            F.aggregate("_pairs", F.lit(0.0), lambda a, x: a + x["w"])).alias("mean_rank"),
    )
    order = [F.col("median_rank").asc_nulls_last(), F.col("mean_rank").asc_nulls_last(), F.col(item).asc()]
    if small_enough(hot, 0):
        return fused.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return positions(fused, group, order, "position", window_rows)
