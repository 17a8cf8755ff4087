"""Planned events: archetypes, what-if scenarios and the event calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.numbers import COORD_SCALE, round_half_even, tenths
from kerbwise.functions.quantiles import exact_quantile
from kerbwise.functions.text import archetype
from kerbwise.operators.surface import planned
from kerbwise.session import cut


def with_archetype(df: DataFrame, rules=S.REPORT_RULES, default: str = S.DEFAULT_ARCHETYPE) -> DataFrame:
    return df.withColumn("archetype", archetype(F.col("description"), rules, default))


def counted(events: DataFrame, keys: list[str]) -> DataFrame:
    """Planned events as stored counts per combination of the values that the reports use.
    The log is read once for all figures of a report."""
    return cut(events.groupBy(*keys, "impact_min", "exp_clearance_min", "closure").agg(F.count(F.lit(1)).alias("n")))


def frequencies(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return counts.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("n").alias("freq"))


def group_quantile(counts: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact quantile of a score or expected clearance; both take few distinct values."""
    return exact_quantile(frequencies(counts, keys, value), keys, value, q, name).drop(f"{name}_n")


def event_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("events"), F.sum(F.col("closure") * F.col("n")).alias("closures"))


def planned_archetypes(enriched: DataFrame) -> DataFrame:
    """Count, closures, median impact and median clearance per archetype."""
    keys = ["archetype"]
    events = counted(with_archetype(planned(enriched)), keys)
    totals = event_totals(events, keys)
    return (
        totals.join(group_quantile(events, keys, "impact_min", 0.5, "med_impact"), keys)
        .join(group_quantile(events, keys, "exp_clearance_min", 0.5, "med_clearance"), keys)
        .select(
            "archetype",
            "events",
            round_half_even(F.col("med_impact"), 4).alias("med_impact"),
            "closures",
            round_half_even(F.col("med_clearance"), 4).alias("med_clearance"),
        )
    )


def planned_p90(enriched: DataFrame) -> DataFrame:
    """As above on the calendar rules, with the 90th percentile of clearance."""
    keys = ["archetype"]
    events = counted(with_archetype(planned(enriched), S.CALENDAR_RULES), keys)
    totals = event_totals(events, keys)
    return (
        totals.join(group_quantile(events, keys, "impact_min", 0.5, "med_impact"), keys)
        .join(group_quantile(events, keys, "exp_clearance_min", 0.9, "p90_clear"), keys)
        .select(
            "archetype",
            "events",
            round_half_even(F.col("med_impact"), 4).alias("med_impact"),
            round_half_even(F.col("p90_clear")).alias("p90_clear"),
            "closures",
        )
    )


def scenario_archetypes(enriched: DataFrame) -> DataFrame:
    """Typical place, impact bump and hold time of each named event archetype."""
    events = (
        with_archetype(planned(enriched), S.SCENARIO_RULES, S.DEFAULT_SCENARIO)
        .filter(F.col("archetype") != S.DEFAULT_SCENARIO)
        .withColumnRenamed("archetype", "name")
        .withColumn("lat_e7", F.rint(F.col("lat") * float(COORD_SCALE)).cast("long"))
        .withColumn("lon_e7", F.rint(F.col("lon") * float(COORD_SCALE)).cast("long"))
    )
    keys = ["name"]
    events = counted(events, [*keys, "lat_e7", "lon_e7"])

    def coordinate_median(value: str) -> DataFrame:
        return exact_quantile(
            frequencies(events, keys, value), keys, value, 0.5, f"med_{value}", coarse_width=COORD_SCALE // 1000
        ).drop(f"med_{value}_n")

    return (
        events.groupBy(*keys)
        .agg(F.sum("n").alias("events"))
        .join(coordinate_median("lat_e7"), keys)
        .join(coordinate_median("lon_e7"), keys)
        .join(group_quantile(events, keys, "impact_min", 0.5, "med_impact"), keys)
        .join(group_quantile(events, keys, "exp_clearance_min", 0.9, "p90"), keys)
        .select(
            "name",
            round_half_even(F.col("med_lat_e7") / float(COORD_SCALE), 5).alias("lat"),
            round_half_even(F.col("med_lon_e7") / float(COORD_SCALE), 5).alias("lon"),
            round_half_even(F.col("med_impact")).alias("bump"),
            "events",
            F.col("p90").cast("int").alias("p90_hold"),
        )
    )


def calendar_uplift(enriched: DataFrame, coverage: DataFrame) -> DataFrame:
    """For every calendar day and weekday with planned events: the plan coverage of
    that weekday and, per archetype, total impact and 90th percentile hold.

    ``coverage`` is ``(dow, coverage_pct)`` with at most seven rows.
    """
    events = (
        with_archetype(planned(enriched), S.CALENDAR_RULES)
        .filter(F.col("date").isNotNull())
        .withColumn("day", F.dayofmonth("date"))
    )
    keys = ["month", "day", "archetype"]
    events = counted(events, [*keys, "dow"])
    total = F.sum(tenths(F.col("impact_min")) * F.col("n")).cast("double") / F.lit(10.0)
    uplift = events.groupBy(*keys).agg(round_half_even(total, 1).alias("impact"))
    hold = group_quantile(events, keys, "exp_clearance_min", 0.9, "p90")
    weekdays = events.select("month", "day", "dow").distinct()
    return (
        uplift.join(hold, keys)
        .join(weekdays, ["month", "day"])
        .join(F.broadcast(coverage), "dow", "left")
        .select(
            "month",
            "day",
            "dow",
            F.coalesce("coverage_pct", F.lit(0.0)).alias("base_coverage"),
            "archetype",
            "impact",
            F.col("p90").cast("int").alias("hold_min"),
        )
    )


def plan_for_date(enriched: DataFrame, plan: DataFrame, month: int, day: int, dow: int) -> DataFrame:
    """Lookup for one date: base units of the weekday and planned uplift as rows."""
    base = plan.filter(F.col("dow") == dow).select(
        F.lit("unit").alias("kind"), F.col("k").cast("string").alias("name"), "lat", "lon",
        F.col("covers").alias("impact"), F.lit(None).cast("int").alias("hold_min"),
    )
    hits = calendar_uplift(enriched, plan.select("dow", F.lit(0.0).alias("coverage_pct")).distinct())
    uplift = hits.filter((F.col("month") == month) & (F.col("day") == day)).select(
        F.lit("uplift").alias("kind"), F.col("archetype").alias("name"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "impact", "hold_min",
    ).distinct()
    return base.unionByName(uplift)
