"""Daily, weekday and corridor loads; days that stand out from their weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.functions.numbers import round_half_even, sum_tenths
from kerbwise.operators.surface import most_frequent, planned, unplanned


def daily_load(enriched: DataFrame) -> DataFrame:
    return (
        unplanned(enriched)
        .filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(sum_tenths(F.col("impact_min")).alias("impact"), F.count(F.lit(1)).alias("n"))
    )


def dow_load(enriched: DataFrame) -> DataFrame:
    return (
        unplanned(enriched)
        .filter(F.col("dow").isNotNull())
        .groupBy("dow")
        .agg(round_half_even(sum_tenths(F.col("impact_min"))).alias("impact"))
    )


def corridor_load(enriched: DataFrame, top: int = 10) -> DataFrame:
    return (
        unplanned(enriched)
        .groupBy("corridor")
        .agg(sum_tenths(F.col("impact_min")).alias("impact"))
        .orderBy(F.desc("impact"), "corridor")
        .limit(top)
        .select("corridor", round_half_even(F.col("impact")).alias("impact"))
    )


def abnormal_days(enriched: DataFrame, top: int = 6) -> DataFrame:
    """Days with the largest z-score against days of the same weekday.

    The input of the window is one row per calendar date.
    """
    same_weekday = Window.partitionBy("dow")
    scored = (
        daily_load(enriched)
        .withColumn("dow", F.weekday("date"))
        .withColumns(
            {
                "mu": F.avg("impact").over(same_weekday),
                "sd": F.stddev_samp("impact").over(same_weekday),
            }
        )
        .withColumn("z", round_half_even(F.try_divide(F.col("impact") - F.col("mu"), F.col("sd")), 2))
    )
    return (
        scored.orderBy(F.desc_nulls_last("z"), "date").limit(top).select("date", "dow", "impact", "n", "z")
    )


def abnormal_context(enriched: DataFrame, flagged: DataFrame) -> DataFrame:
    """Most frequent cause and first planned event of each flagged day (a few rows)."""
    days = F.broadcast(flagged.select("date"))
    causes = (
        unplanned(enriched).join(days, "date").groupBy("date", "cause").agg(F.count(F.lit(1)).alias("n"))
    )
    events = (
        planned(enriched)
        .filter(F.col("description").isNotNull())
        .join(days, "date")
        .groupBy("date")
        .agg(F.min_by("description", F.struct("t_event", "id")).alias("first"))
    )
    return (
        flagged.join(most_frequent(causes, ["date"], "cause", "top_cause"), "date", "left")
        .join(events, "date", "left")
        .select(
            "date",
            "z",
            F.col("impact").cast("long").alias("impact"),
            F.coalesce("top_cause", F.lit("—")).alias("cause"),
            F.substring(F.coalesce("first", F.lit("")), 1, 48).alias("event"),
        )
    )
