"""Barricade zones at the approaches of road closures."""

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
from kerbwise.functions.text import urgency_label, urgency_tier
from kerbwise.operators.surface import CELL, most_frequent
from kerbwise.session import cut


def _finite(value: Column) -> Column:
    """A coordinate on the globe or null: a stray number cannot be an end of a road."""
    return F.when(F.abs(value) <= 180, value)


def approach_points(enriched: DataFrame) -> DataFrame:
    """One row per closure approach: the incident point, and the segment end when it
    is present and a different place."""
    end_lat, end_lon = (_finite(F.expr(f"try_cast({c} AS double)")) for c in ("endlatitude", "endlongitude"))
    apart = F.abs(F.col("_elat") - F.col("lat")) + F.abs(F.col("_elon") - F.col("lon")) > 1e-4
    distinct_end = F.col("_elat").isNotNull() & F.col("_elon").isNotNull() & (F.col("_elat") != 0) & apart
    primary = F.struct(F.lit(0).alias("kind"), F.col("lat"), F.col("lon"))
    end = F.struct(F.lit(1).alias("kind"), F.col("_elat").alias("lat"), F.col("_elon").alias("lon"))
    points = F.when(distinct_end, F.array(primary, end)).otherwise(F.array(primary))
    return (
        enriched.filter(F.col("closure") == 1)
        .withColumns({"_elat": end_lat, "_elon": end_lon})
        .select(
            "id", F.explode(points).alias("p"), "corridor", "junction", "cause", "event_type",
            F.col("impact_min").alias("impact"),
        )
        .select("id", "p.kind", "p.lat", "p.lon", "corridor", "junction", "cause", "impact", "event_type")
    )


def barricade_zones(enriched: DataFrame) -> DataFrame:
    """Approaches clustered on the fine grid with their modes and a priority score."""
    combined = cut(
        with_grid(approach_points(enriched), S.ZONE_GRID_DEG)
        .groupBy(*CELL, "corridor", "junction", "cause")
        .agg(
            F.sum(offset_e7(F.col("lat"), LAT_ORIGIN_E7)).alias("lat_off"),
            F.sum(offset_e7(F.col("lon"), LON_ORIGIN_E7)).alias("lon_off"),
            F.count(F.lit(1)).alias("n"),
            F.sum(tenths(F.col("impact"))).alias("impact_t"),
            F.count_if(F.col("event_type") == "planned").alias("planned"),
        )
    )
    n = F.sum("n")
    zones = combined.groupBy(*CELL).agg(
        mean_from_offsets(F.sum("lat_off"), n, LAT_ORIGIN_E7).alias("lat"),
        mean_from_offsets(F.sum("lon_off"), n, LON_ORIGIN_E7).alias("lon"),
        n.alias("approaches"),
        (F.sum("impact_t").cast("double") / F.lit(10.0)).alias("impact"),
        F.sum("planned").alias("planned"),
    )
    rank = Window.partitionBy(*CELL).orderBy(F.desc("n"), "cause")
    top_two = (
        combined.groupBy(*CELL, "cause")
        .agg(F.sum("n").alias("n"))
        .withColumn("r", F.row_number().over(rank))
        .filter(F.col("r") <= 2)
        .groupBy(*CELL)
        .agg(
            F.max(F.when(F.col("r") == 1, F.col("cause"))).alias("first_cause"),
            F.max(F.when(F.col("r") == 2, F.col("cause"))).alias("second_cause"),
        )
    )
    return (
        zones.join(most_frequent(combined, CELL, "corridor", "corridor"), CELL, "left")
        .join(most_frequent(combined, CELL, "junction", "junction"), CELL, "left")
        .join(top_two, CELL, "left")
        .select(
            *CELL, "lat", "lon", "approaches", "impact", "corridor", "junction", "planned",
            F.concat_ws(", ", "first_cause", "second_cause").alias("causes"),
            "first_cause",
            round_half_even(F.col("approaches") * F.log1p("impact")).alias("priority_score"),
        )
    )


def barricade_plan(zones: DataFrame, diversion: DataFrame, top: int = 12) -> DataFrame:
    """The highest-ranked zones with barricade count, diversion and response tier."""
    first = diversion.filter(F.col("rank") == 1).select(
        F.col("src").alias("corridor"), F.col("dst").alias("via")
    )
    chosen = zones.orderBy(F.desc("priority_score"), *CELL).limit(top)
    points = F.greatest(F.lit(2), F.least(F.lit(4), F.rint(F.col("approaches") / 2).cast("int")))
    tier = urgency_tier(F.col("first_cause"))
    return chosen.join(first, "corridor", "left").select(
        *CELL,
        round_half_even(F.col("lat"), 5).alias("lat"),
        round_half_even(F.col("lon"), 5).alias("lon"),
        "corridor",
        F.coalesce("junction", F.lit("(approach)")).alias("junction"),
        "causes",
        "approaches",
        points.alias("barricade_points"),
        F.coalesce("via", F.lit("local parallel street")).alias("divert_via"),
        "planned",
        round_half_even(F.col("impact")).alias("impact"),
        tier.alias("tier"),
        urgency_label(tier).alias("response"),
    )
