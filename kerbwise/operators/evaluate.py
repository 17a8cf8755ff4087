"""Evaluation of plans and forecasts: reach, counterfactual, equity, confidence, capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import haversine_km, with_grid
from kerbwise.functions.numbers import mean_lat, mean_lon, round_half_even, sum_tenths, tenths
from kerbwise.functions.quantiles import exact_quantile, value_counts
from kerbwise.operators.surface import (
    CELL,
    cell_date_panel,
    first_day,
    holdout_start,
    last_day,
    unplanned,
)
from kerbwise.session import cut


def reach(enriched: DataFrame, plan: DataFrame, reach_km: float = S.REACH_KM) -> DataFrame:
    """Unplanned incidents with the flag ``reached`` against the plan of their weekday.

    The plan is folded to one array of units per weekday: at most seven rows, each
    as long as the number of units. Incidents are tested in place and never
    multiplied. A weekday without a plan reaches nothing.
    """
    units = plan.groupBy("dow").agg(F.collect_list(F.struct("lat", "lon")).alias("units"))

    def close(unit: Column) -> Column:
        return haversine_km(F.col("lat"), F.col("lon"), unit["lat"], unit["lon"]) <= reach_km

    return (
        unplanned(enriched)
        .join(F.broadcast(units), "dow", "left")
        .withColumn("reached", F.coalesce(F.exists("units", close), F.lit(False)))
        .drop("units")
    )


def quantile_scalar(df: DataFrame, value: str, q: float) -> Column:
    """Exact quantile of a column with few distinct values, as a scalar subquery."""
    return exact_quantile(value_counts(df, [], value), [], value, q, "q").select("q").scalar()


def counterfactual(reached: DataFrame, share: float = S.PREVENTABLE_SHARE) -> DataFrame:
    """Share of incidents and impact the plan would have reached, overall and for the
    quarter with the highest impact."""
    reached = cut(reached.groupBy("impact_min", "reached").agg(F.count(F.lit(1)).alias("n")))
    freq = reached.groupBy("impact_min").agg(F.sum("n").alias("freq")).filter(F.col("impact_min").isNotNull())
    threshold = exact_quantile(freq, [], "impact_min", 0.75, "q").select("q").scalar()
    severe = F.col("impact_min") >= threshold
    hit = F.col("reached")
    impact = tenths(F.col("impact_min")) * F.col("n")

    def number(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    def minutes(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, impact)), F.lit(0)).cast("double") / F.lit(10.0)

    sums = reached.withColumn("severe", severe).agg(
        number(F.lit(True)).alias("n"),
        number(hit).alias("n_hit"),
        (F.sum(impact).cast("double") / F.lit(10.0)).alias("total"),
        minutes(hit).alias("hit_impact"),
        number(F.col("severe")).alias("n_sev"),
        number(F.col("severe") & hit).alias("n_sev_hit"),
        minutes(F.col("severe") & hit).alias("sev_hit_impact"),
    )
    prevented = F.col("hit_impact") * F.lit(share)
    return sums.select(
        _pct(F.col("n_hit"), F.col("n")).alias("reach_pct"),
        F.rint("total").alias("total_congestion_min"),
        F.rint(prevented).alias("prevented_congestion_min"),
        _pct(prevented, F.col("total")).alias("prevented_pct"),
        _pct(F.col("n_sev_hit"), F.col("n_sev")).alias("esc_reach_pct"),
        F.rint(F.col("sev_hit_impact") * F.lit(share)).alias("esc_prevented_min"),
    )


def _pct(part: Column, whole: Column) -> Column:
    return round_half_even(F.try_divide(F.lit(100.0) * part, whole), 1)


def equity_by_zone(reached: DataFrame, worst: int = 3) -> DataFrame:
    """Reach per zone from worst to best, with the gap between the extremes."""
    zones = cut(
        reached.filter(F.col("zone").isNotNull())
        .groupBy("zone")
        .agg(
            F.count(F.lit(1)).alias("incidents"),
            _pct(F.count_if("reached"), F.count(F.lit(1))).alias("reached_pct"),
            sum_tenths(F.col("impact_min")).alias("impact"),
        )
    )
    gap = zones.agg((F.max("reached_pct") - F.min("reached_pct")).alias("g")).scalar()
    starved = zones.orderBy("reached_pct", "zone").limit(worst).select("zone", F.lit(1).alias("worst_served"))
    return zones.join(starved, "zone", "left").select(
        "zone", "incidents", "reached_pct", "impact",
        F.coalesce("worst_served", F.lit(0)).alias("worst_served"),
        round_half_even(gap, 1).alias("gap_pct"),
    )


def cell_confidence(enriched: DataFrame) -> DataFrame:
    """Confidence 0..100 per cell: grows with history, shrinks with censored rows."""
    cells = cut(
        with_grid(unplanned(enriched))
        .groupBy(*CELL)
        .agg(
            mean_lat(F.col("lat")).alias("lat"),
            mean_lon(F.col("lon")).alias("lon"),
            F.count(F.lit(1)).alias("n"),
            (F.sum("clearance_censored") / F.count(F.lit(1))).alias("censored"),
        )
    )
    p95 = quantile_scalar(cells, "n", 0.95)
    history = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(F.col("n")) / F.log1p(p95)))
    return cells.withColumn(
        "confidence", F.rint(history * (F.lit(1.0) - F.lit(0.5) * F.col("censored")) * F.lit(100.0))
    )


def confidence_audit(cells: DataFrame, top: int = 8, min_incidents: int = 3) -> DataFrame:
    """The cells with the lowest confidence, with cell count and median confidence."""
    cells = cut(cells)
    count = cells.agg(F.count(F.lit(1)).alias("c")).scalar()
    median = quantile_scalar(cells, "confidence", 0.5)
    return (
        cells.filter(F.col("n") >= min_incidents)
        .orderBy("confidence", *CELL)
        .limit(top)
        .select(
            *CELL,
            round_half_even(F.col("lat"), 5).alias("lat"),
            round_half_even(F.col("lon"), 5).alias("lon"),
            F.col("n").alias("incidents"),
            F.col("confidence").cast("int").alias("confidence"),
            count.alias("n_cells"),
            median.cast("int").alias("median_confidence"),
        )
    )


def capture_by_date(scored: DataFrame, keys: list[str] | None = None, share: float = S.TOP_SHARE) -> DataFrame:
    """Share of each day's impact inside the cells ranked highest by ``score``.

    A day has one row per cell, so a window partition is bounded by the grid.
    Days without impact are left out.
    """
    day = (keys or []) + ["date"]
    ranked = Window.partitionBy(*day).orderBy(F.desc("score"), *CELL)
    whole = Window.partitionBy(*day)
    marked = scored.withColumns(
        {"r": F.row_number().over(ranked), "cells": F.count(F.lit(1)).over(whole)}
    )
    top = F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("cells")))
    y = F.rint(F.col("y") * F.lit(10.0)).cast("long")
    return (
        marked.groupBy(*day)
        .agg(F.coalesce(F.sum(F.when(top, y)), F.lit(0)).alias("caught"), F.sum(y).alias("all"))
        .filter(F.col("all") > 0)
        .select(*day, (F.col("caught") / F.col("all")).alias("capture"))
    )


def mean_capture(captures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    fixed = F.sum(F.rint(F.col("capture") * F.lit(1e9)).cast("long")) / F.count(F.lit(1)) / F.lit(1e9)
    return captures.groupBy(*(keys or [])).agg(
        round_half_even(F.lit(100.0) * fixed, 1).alias("capture_pct"), F.count(F.lit(1)).alias("days")
    )


def cell_mean_baseline(panel: DataFrame) -> DataFrame:
    """Mean daily impact per cell before the hold-out, on every hold-out row."""
    start = holdout_start(panel)
    trained = panel.filter(F.col("date") < start).groupBy(*CELL).agg(
        (sum_tenths(F.col("y")) / F.count(F.lit(1))).alias("score")
    )
    return (
        panel.filter(F.col("date") >= start)
        .select(*CELL, "date", "y")
        .join(trained, CELL, "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )


def capture_at_top(days: DataFrame) -> DataFrame:
    """Per hold-out day: share of impact caught by the top cells of the baseline."""
    return capture_by_date(cell_mean_baseline(cell_date_panel(days))).select(
        "date", round_half_even(F.col("capture"), 6).alias("capture")
    )


def fold_start(source: DataFrame, fold: Column) -> Column:
    return F.date_add(first_day(source), S.WARMUP_DAYS + S.FOLD_DAYS * fold)


def fold_count(source: DataFrame) -> Column:
    """Number of weekly folds whose start lies more than a week before the last day."""
    span = F.datediff(last_day(source), first_day(source)) - S.FOLD_DAYS - S.WARMUP_DAYS
    return F.greatest(F.lit(0), F.ceil(span / F.lit(float(S.FOLD_DAYS)))).cast("int")


def walk_forward_scores(days: DataFrame) -> DataFrame:
    """Cell-mean score of every (fold, cell, date) using days before the fold only.

    ``days`` comes from ``cell_days``. All folds come from one pass: impact and
    incidents are summed per (cell, fold) and accumulated over folds. A cell takes
    part once it has enough incidents before the fold.
    """
    daily = days.filter(F.col("date").isNotNull()).withColumnRenamed("impact_t", "y_t")
    source = daily
    first = first_day(source)
    since = F.datediff(F.col("date"), first) - S.WARMUP_DAYS
    fold = F.when(since < 0, F.lit(-1)).otherwise(F.floor(since / S.FOLD_DAYS).cast("int"))
    per_fold = daily.groupBy(*CELL, fold.alias("fold")).agg(F.sum("y_t").alias("y_t"), F.sum("n").alias("n"))
    folds = fold_count(source)
    cells = per_fold.select(*CELL).distinct()
    all_folds = F.when(folds > 0, F.sequence(F.lit(-1), folds - 1))
    before = Window.partitionBy(*CELL).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    grid = (
        cells.withColumn("fold", F.explode(all_folds))
        .join(per_fold, [*CELL, "fold"], "left")
        .withColumns({"past_y": F.sum("y_t").over(before), "past_n": F.sum("n").over(before)})
        .filter((F.col("fold") >= 0) & (F.col("past_n") >= S.PANEL_MIN_INCIDENTS))
    )
    train_days = F.lit(S.WARMUP_DAYS) + F.lit(S.FOLD_DAYS) * F.col("fold")
    scored = grid.select(
        "fold", *CELL, train_days.alias("train_days"),
        (F.coalesce("past_y", F.lit(0)).cast("double") / F.lit(10.0) / train_days).alias("score"),
        F.explode(F.sequence(F.lit(0), F.lit(S.FOLD_DAYS - 1))).alias("_d"),
    ).withColumn("date", F.date_add(first, F.col("train_days") + F.col("_d"))).drop("_d")
    actual = daily.select(*CELL, "date", (F.col("y_t").cast("double") / F.lit(10.0)).alias("y"))
    return (
        scored.filter(F.col("date") <= last_day(source))
        .join(actual, [*CELL, "date"], "left")
        .withColumn("y", F.coalesce("y", F.lit(0.0)))
    )


def walk_forward(scored: DataFrame) -> DataFrame:
    """Capture per week; weeks are numbered over the folds that have a capture."""
    weekly = mean_capture(capture_by_date(scored, ["fold", "train_days"]), ["fold", "train_days"])
    # One row per fold.
    numbered = Window.orderBy("fold")
    return weekly.select(
        F.row_number().over(numbered).alias("week"), F.col("capture_pct").alias("capture"), "train_days"
    )


def summary_meta(enriched: DataFrame) -> DataFrame:
    """Counts, window, total impact, distinct days and censored share of the log.

    Summed per date first, so that one pass yields the distinct days as well.
    """
    per_day = enriched.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "planned").alias("planned"),
        F.count_if(F.col("event_type") == "unplanned").alias("unplanned"),
        F.sum(tenths(F.col("impact_min"))).alias("impact_t"),
        F.sum("clearance_censored").alias("censored"),
        F.count("dur_trust_min").alias("trusted"),
    )
    return per_day.agg(
        F.sum("n").alias("incidents"),
        F.sum("planned").alias("planned"),
        F.sum("unplanned").alias("unplanned"),
        F.floor(F.sum("impact_t") / F.lit(10.0)).cast("long").alias("total_congestion_minutes"),
        F.count("date").alias("days"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("window"),
        F.sum("censored").alias("censored"),
        F.sum("trusted").alias("trusted"),
        _pct(F.sum("censored"), F.sum("n")).alias("censored_pct"),
    )
