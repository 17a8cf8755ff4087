"""Sudden gatherings: many incidents close together in a short time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.numbers import round_half_even
from kerbwise.operators.neighbours import PAIR_LIMIT, PLACE_TIME, following, place_time_counts, surroundings
from kerbwise.session import cut, shuffled


def cause_neighbours(enriched: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Neighbour counts per anchor place and time and per cause: ``(t_s, lat, lon, cause, n)``."""
    counts = cut(place_time_counts(enriched, "cause"))
    return neighbours_from(counts, counts.select(*PLACE_TIME).distinct(), pair_limit)


def neighbours_from(counts: DataFrame, anchors: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``cause_neighbours`` from stored ``place_time_counts``."""
    found = following(anchors, counts, "cause", S.BURST_KM, S.PAIR_WINDOW_SEC, pair_limit=pair_limit)
    return found.groupBy(*PLACE_TIME, F.col("p_cause").alias("cause")).agg(F.sum("p_n").alias("n"))


def neighbourhood_figures() -> list[Column]:
    """Size, number of causes and dominant cause from counts per cause."""
    return [
        F.sum("n").alias("size"),
        F.count(F.lit(1)).alias("mix"),
        F.max("n").alias("dom_n"),
        F.min_by("cause", F.struct(-F.col("n"), F.col("cause"))).alias("dom_cause"),
        F.max(F.col("cause").isin(*S.LIVE_CAUSES)).alias("live"),
    ]


def neighbourhoods(enriched: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Figures of the neighbourhood of each anchor place and second, found where the anchor is compared unless a box is crowded."""
    counts = cut(place_time_counts(enriched, "cause"))
    anchors = counts.select(*PLACE_TIME).distinct()
    found = surroundings(anchors, counts, "cause", S.BURST_KM, S.PAIR_WINDOW_SEC, S.LIVE_CAUSES, pair_limit)
    if found is not None:
        return found
    return neighbours_from(counts, anchors, pair_limit).groupBy(*PLACE_TIME).agg(*neighbourhood_figures())


def with_place_time(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("t_event").isNotNull()).withColumn("t_s", F.unix_seconds("t_event"))


def burst_neighbours(enriched: DataFrame) -> DataFrame:
    """Per incident: how many incidents follow it within the window and radius, itself
    and all incidents of the same second included, and of how many causes."""
    around = neighbourhoods(enriched).select(*PLACE_TIME, "size", "mix")
    return with_place_time(enriched).select("id", *PLACE_TIME).join(shuffled(around), PLACE_TIME).select("id", "size", "mix")


def is_burst() -> Column:
    share = F.col("dom_n") / F.col("size")
    survey = (share > 0.7) & F.col("dom_cause").isin(*S.PASSIVE_CAUSES)
    return (F.col("size") >= S.BURST_MIN_SIZE) & ~survey & (F.col("live") | (F.col("mix") >= 3))


def burst_score(enriched: DataFrame) -> DataFrame:
    """Anchor incidents whose neighbourhood qualifies as a gathering."""
    flagged = neighbourhoods(enriched).filter(is_burst())
    return (
        with_place_time(enriched)
        .join(shuffled(flagged), PLACE_TIME)
        .select(
            "id", "t_event", "t_s", "lat", "lon", "date", "corridor", "description",
            "size", "mix", "dom_cause", round_half_even(F.col("dom_n") / F.col("size"), 4).alias("dom_share"),
        )
    )


def burst_dedup(scored: DataFrame, top: int = 8) -> DataFrame:
    """The largest burst per (place to 2 decimals, date); the largest few overall."""
    order = F.struct(-F.col("size"), F.col("t_s"), F.col("id"))
    report = F.struct("id", "t_event", "t_s", "lat", "lon", "corridor", "description", "size", "mix", "dom_cause")
    best = (
        scored.groupBy(
            round_half_even(F.col("lat"), 2).alias("lat2"), round_half_even(F.col("lon"), 2).alias("lon2"), "date"
        )
        .agg(F.min_by(report, order).alias("r"))
        .select("r.*")
    )
    return (
        best.orderBy(F.desc("size"), "t_s", "id")
        .limit(top)
        .select(
            "id",
            F.date_format("t_event", "yyyy-MM-dd HH:mm").alias("started"),
            round_half_even(F.col("lat"), 5).alias("lat"),
            round_half_even(F.col("lon"), 5).alias("lon"),
            "size",
            F.col("corridor").alias("area"),
            F.col("dom_cause").alias("cause"),
            "mix",
            F.substring(F.coalesce("description", F.lit("")), 1, 46).alias("text"),
        )
    )
