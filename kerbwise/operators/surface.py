"""Spatial grid aggregates: risk cells, weekday loads, hotspots and the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import with_grid
from kerbwise.functions.numbers import (
    LAT_ORIGIN_E7,
    LON_ORIGIN_E7,
    mean_from_offsets,
    offset_e7,
    round_half_even,
    tenths,
)
from kerbwise.session import cut

CELL = ["gy", "gx"]


def unplanned(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("event_type") == "unplanned")


def planned(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("event_type") == "planned")


def distinct_days(df: DataFrame) -> Column:
    """Number of distinct dates, as a scalar subquery (at least 1).

    Reduced to distinct dates first: the optimizer then drops the lookup joins.
    """
    dates = df.select("date").distinct()
    return F.greatest(F.lit(1), dates.select(F.count("date").alias("days")).scalar())


def most_frequent(counts: DataFrame, keys: list[str], value: str, name: str, n: str = "n") -> DataFrame:
    """Most frequent value per group from ``(keys, value, n)`` rows; ties to the smallest."""
    per_value = counts.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    return per_value.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def cell_dow_load(enriched: DataFrame) -> DataFrame:
    """Impact per cell and weekday, divided by the city-wide number of such days."""
    return _dow_load(weekday_sums(enriched))


def weekday_sums(enriched: DataFrame) -> DataFrame:
    """Sums per (cell, date) of the unplanned track, stored: weekday loads, the number of
    days and the centroids follow from them without another read of the log."""
    return cut(
        with_grid(unplanned(enriched)).groupBy(*CELL, "date", "dow").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(tenths(F.col("impact_min"))).alias("impact_t"),
            F.sum(offset_e7(F.col("lat"), LAT_ORIGIN_E7)).alias("lat_off"),
            F.sum(offset_e7(F.col("lon"), LON_ORIGIN_E7)).alias("lon_off"),
        )
    )


def _dow_load(sums: DataFrame) -> DataFrame:
    days = (
        sums.filter(F.col("date").isNotNull())
        .select("date", "dow")
        .distinct()
        .groupBy("dow")
        .agg(F.count(F.lit(1)).alias("days"))
    )
    load = sums.filter(F.col("dow").isNotNull()).groupBy(*CELL, "dow").agg(
        (F.sum("impact_t").cast("double") / F.lit(10.0)).alias("sum_impact")
    )
    # A weekday takes one of seven values, so this side has at most seven rows.
    return load.join(F.broadcast(days), "dow").select(
        *CELL,
        "dow",
        "sum_impact",
        round_half_even(F.col("sum_impact") / F.col("days"), 1).alias("exp_impact_per_day"),
    )


def cell_summary(source: DataFrame) -> DataFrame:
    """Centroid, count, impact and most frequent cause and corridor per cell.

    Incidents are first combined per (cell, cause, corridor); a cell that holds a
    large share of the log is reduced to its label combinations before it moves.
    """
    combined = (
        with_grid(source)
        .groupBy(*CELL, "cause", "corridor")
        .agg(
            F.sum(offset_e7(F.col("lat"), LAT_ORIGIN_E7)).alias("lat_off"),
            F.sum(offset_e7(F.col("lon"), LON_ORIGIN_E7)).alias("lon_off"),
            F.count(F.lit(1)).alias("n"),
            F.sum(tenths(F.col("impact_min"))).alias("impact_t"),
        )
    )
    by_cause = Window.partitionBy(*CELL, "cause")
    by_corridor = Window.partitionBy(*CELL, "corridor")
    counted = combined.withColumn("n_cause", F.sum("n").over(by_cause)).withColumn(
        "n_corridor", F.sum("n").over(by_corridor)
    )
    n = F.sum("n")
    return counted.groupBy(*CELL).agg(
        mean_from_offsets(F.sum("lat_off"), n, LAT_ORIGIN_E7).alias("lat"),
        mean_from_offsets(F.sum("lon_off"), n, LON_ORIGIN_E7).alias("lon"),
        n.alias("n"),
        (F.sum("impact_t").cast("double") / F.lit(10.0)).alias("impact"),
        F.min_by("cause", F.struct(-F.col("n_cause"), F.col("cause"))).alias("top_cause"),
        F.min_by("corridor", F.struct(-F.col("n_corridor"), F.col("corridor"))).alias("top_corridor"),
    )


def risk_cells(enriched: DataFrame) -> DataFrame:
    """Cells of the unplanned track with their expected impact per day."""
    source = unplanned(enriched)
    return cell_summary(source).withColumn(
        "exp_impact_per_day", round_half_even(F.col("impact") / distinct_days(source), 1)
    )


def hotspots(enriched: DataFrame, top: int = 15) -> DataFrame:
    """Cells with the largest impact; per day over all dates of the log."""
    ranked = cell_summary(unplanned(enriched)).orderBy(F.desc("impact"), *CELL).limit(top)
    return ranked.select(
        *CELL,
        round_half_even(F.col("lat"), 5).alias("lat"),
        round_half_even(F.col("lon"), 5).alias("lon"),
        "n",
        round_half_even(F.col("impact") / distinct_days(enriched), 1).alias("per_day"),
        F.col("top_cause").alias("cause"),
        F.col("top_corridor").alias("corridor"),
    )


def weekday_risk(enriched: DataFrame) -> DataFrame:
    """Expected impact per cell and weekday at the cell centroid (no model)."""
    sums = weekday_sums(enriched)
    n = F.sum("n")
    centroids = sums.groupBy(*CELL).agg(
        mean_from_offsets(F.sum("lat_off"), n, LAT_ORIGIN_E7).alias("lat"),
        mean_from_offsets(F.sum("lon_off"), n, LON_ORIGIN_E7).alias("lon"),
    )
    return (
        _dow_load(sums)
        .join(centroids, CELL)
        .select(*CELL, "lat", "lon", "dow", F.col("exp_impact_per_day").alias("exp_impact"))
    )


def heat(risk: DataFrame) -> DataFrame:
    """Mean expected impact per cell over the weekdays it occurs on."""
    mean = F.sum(F.rint(F.col("exp_impact") * 1e6).cast("long")).cast("double") / 1e6 / F.count(F.lit(1))
    return (
        risk.groupBy(*CELL, "lat", "lon")
        .agg(mean.alias("mean"))
        .filter(F.col("mean") > 0)
        .select(
            *CELL,
            round_half_even(F.col("lat"), 5).alias("lat"),
            round_half_even(F.col("lon"), 5).alias("lon"),
            round_half_even(F.col("mean"), 1).alias("exp_impact"),
        )
    )


def dow_vector(risk: DataFrame) -> DataFrame:
    """One row per cell with its seven weekday weights, absent days 0."""
    wide = risk.groupBy(*CELL, "lat", "lon").pivot("dow", list(range(7))).agg(F.max("exp_impact"))
    weights = F.array(*[round_half_even(F.coalesce(F.col(str(d)), F.lit(0.0)), 1) for d in range(7)])
    return wide.select(
        *CELL,
        round_half_even(F.col("lat"), 5).alias("lat"),
        round_half_even(F.col("lon"), 5).alias("lon"),
        weights.alias("w"),
    )


def cell_days(enriched: DataFrame) -> DataFrame:
    """Sums per (cell, date) of the unplanned track, computed once and stored.

    The panel, its features for any cut-off date and every walk-forward fold follow
    from these rows; their number is bounded by cells x days.
    """
    return cut(
        with_grid(unplanned(enriched))
        .groupBy(*CELL, "date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(tenths(F.col("impact_min"))).alias("impact_t"),
            F.sum(offset_e7(F.col("lat"), LAT_ORIGIN_E7)).alias("lat_off"),
            F.sum(offset_e7(F.col("lon"), LON_ORIGIN_E7)).alias("lon_off"),
            F.sum(F.rint(F.col("corridor_crit") * F.lit(1e9)).cast("long")).alias("crit_e9"),
        )
    )


def last_day(df: DataFrame) -> Column:
    return df.select(F.max("date").alias("d")).scalar()


def first_day(df: DataFrame) -> Column:
    return df.select(F.min("date").alias("d")).scalar()


def holdout_start(df: DataFrame, days: int = S.HOLDOUT_DAYS) -> Column:
    """First held-out date: the day after the last training date."""
    return F.date_add(last_day(df), 1 - days)


def panel_cells(days: DataFrame, as_of: Column | None) -> DataFrame:
    """Cell features from incidents before ``as_of`` (all incidents when None)."""
    history = days if as_of is None else days.filter(F.col("date") < as_of)
    n = F.sum("n")
    return (
        history.groupBy(*CELL)
        .agg(
            mean_from_offsets(F.sum("lat_off"), n, LAT_ORIGIN_E7).alias("lat"),
            mean_from_offsets(F.sum("lon_off"), n, LON_ORIGIN_E7).alias("lon"),
            n.alias("hist_n"),
            (F.sum("impact_t").cast("double") / F.lit(10.0)).alias("hist_impact"),
            (F.sum("crit_e9").cast("double") / n / F.lit(1e9)).alias("crit"),
        )
        .filter(F.col("hist_n") >= S.PANEL_MIN_INCIDENTS)
    )


def cell_date_panel(days: DataFrame, as_of: Column | str | None = "holdout", leaky: bool = False) -> DataFrame:
    """Zero-filled impact per stable cell and calendar date, with cell features.

    ``days`` comes from ``cell_days``. Features use incidents before ``as_of`` only
    (default: the start of the hold-out); ``leaky=True`` takes them from the whole
    window instead.
    """
    if leaky:
        as_of = None
    elif isinstance(as_of, str) and as_of == "holdout":
        as_of = holdout_start(days)
    calendar = F.sequence(first_day(days), last_day(days))
    actual = days.select(*CELL, "date", (F.col("impact_t").cast("double") / F.lit(10.0)).alias("y"))
    return (
        panel_cells(days, as_of)
        .withColumn("date", F.explode(calendar))
        .join(actual, [*CELL, "date"], "left")
        .withColumn("y", F.coalesce("y", F.lit(0.0)))
        .withColumns(
            {
                "dow": F.weekday("date"),
                "month": F.month("date"),
                "is_weekend": F.weekday("date").isin(5, 6).cast("int"),
                "hist_rate": F.col("hist_impact") / F.col("hist_n"),
            }
        )
    )
