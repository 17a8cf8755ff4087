"""Exact interpolated quantiles computed from distributed value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count per (keys, value). Counts are combined before the shuffle, so a group
    that holds most rows still arrives as one row per distinct value.

    Nulls are left out by counting, not by a filter on ``value``: a filter would be
    pushed below the cleaning steps with the whole expression of the value inlined.
    """
    return df.groupBy(*keys, value).agg(F.count(value).alias("freq")).filter(F.col("freq") > 0)


def exact_quantile(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    name: str,
    coarse_width: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantile per group from ``(keys, value, freq)`` rows.

    With ``coarse_width`` the ranks are first located in buckets of that width and
    only the values inside the bucket that holds the rank are ordered. Use it where
    the number of distinct values per group has no fixed bound: the first ordering
    is then bounded by the value range, the second by the bucket width.
    Returns ``keys``, ``name`` and the number of observations ``<name>_n``.
    """
    keys = list(keys)
    if coarse_width is None:
        ranked = _ranks(counts, keys, [value], F.lit(0).cast("long"), q)
    else:
        bucketed = counts.withColumn("_b", F.floor(F.col(value) / F.lit(coarse_width)))
        buckets = bucketed.groupBy(*keys, "_b").agg(F.sum("freq").alias("freq"))
        holders = _ranks(buckets, keys, ["_b"], F.lit(0).cast("long"), q)
        holders = holders.filter(F.col("_has_lo") | F.col("_has_hi")).select(
            *[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_b").alias("_hb"), "_start", "_total"
        )
        match = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col("_b") == F.col("_hb")]
        inside = bucketed.join(holders, match).drop("_hb", *[f"_h_{k}" for k in keys])
        ranked = _ranks(
            inside, keys + ["_b"], [value], F.col("_start"), q, total=F.col("_total")
        )
    low, high = F.max(F.when(F.col("_has_lo"), F.col(value))), F.max(F.when(F.col("_has_hi"), F.col(value)))
    position = F.lit(q) * (F.max("_total") - 1)
    share = position - F.floor(position)
    return ranked.groupBy(*keys).agg(
        (low + (high - low) * share).cast("double").alias(name), F.max("_total").alias(f"{name}_n")
    )


def _ranks(
    df: DataFrame, keys: list[str], order: list[str], start: Column, q: float, total: Column | None = None
) -> DataFrame:
    """Mark the rows that contain the ranks below and above position ``q * (n - 1)``."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns(
        {
            "_end": F.sum("freq").over(running) + start,
            "_total": F.sum("freq").over(group) if total is None else total,
        }
    ).withColumn("_start", F.col("_end") - F.col("freq"))
    position = F.lit(q) * (F.col("_total") - 1)

    def holds(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_end"))

    return ranked.withColumns({"_has_lo": holds(F.floor(position)), "_has_hi": holds(F.ceil(position))})
