"""Corridor network: nodes, spillover edges, blast radius, diversions, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import distance_pairs
from kerbwise.functions.numbers import (
    LAT_ORIGIN_E7, LON_ORIGIN_E7, mean_from_offsets, mean_lat, mean_lon, offset_e7, round_half_even, sum_tenths, tenths,
)
from kerbwise.operators.neighbours import PAIR_LIMIT, PLACE_TIME, following, place_time_counts
from kerbwise.operators.surface import unplanned
from kerbwise.session import cut, sized


def corridor_nodes(enriched: DataFrame) -> DataFrame:
    """Named corridors with enough unplanned incidents: centroid, load, count."""
    return (
        unplanned(enriched)
        .filter(F.col("corridor") != S.NON_CORRIDOR)
        .groupBy("corridor")
        .agg(
            mean_lat(F.col("lat")).alias("lat"),
            mean_lon(F.col("lon")).alias("lon"),
            sum_tenths(F.col("impact_min")).alias("load"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") >= S.NODE_MIN_INCIDENTS)
    )


def node_incidents(enriched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unplanned incidents on node corridors."""
    return unplanned(enriched).join(nodes.select("corridor"), "corridor", "left_semi")


def corridor_counts(enriched: DataFrame) -> DataFrame:
    """Unplanned incidents of named corridors per (second, place, corridor), with their impact; without a time too.

    Nodes and pairs both follow from these rows, so the log is read once for the network.
    """
    named = unplanned(enriched).filter(F.col("corridor") != S.NON_CORRIDOR)
    return named.groupBy(F.unix_seconds("t_event").alias("t_s"), "lat", "lon", "corridor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tenths(F.col("impact_min"))).alias("impact_t")
    )


def nodes_from(counts: DataFrame) -> DataFrame:
    """``corridor_nodes`` from stored ``corridor_counts``."""
    n = F.sum("n")
    lat, lon = (F.sum(offset_e7(F.col(c), o) * F.col("n")) for c, o in (("lat", LAT_ORIGIN_E7), ("lon", LON_ORIGIN_E7)))
    return (
        counts.groupBy("corridor")
        .agg(
            mean_from_offsets(lat, n, LAT_ORIGIN_E7).alias("lat"),
            mean_from_offsets(lon, n, LON_ORIGIN_E7).alias("lon"),
            (F.sum("impact_t").cast("double") / F.lit(10.0)).alias("load"),
            n.alias("n"),
        )
        .filter(F.col("n") >= S.NODE_MIN_INCIDENTS)
    )


def spillover_pairs(incidents: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Number of follow-on pairs per ordered corridor pair ``(src, dst, count)``.

    A pair is an incident and a later one on another corridor within the time
    window and radius. Within one second the alphabetically smaller corridor is the
    source, so each pair counts once and never depends on row order.
    """
    return pairs_from(cut(place_time_counts(incidents, "corridor")), pair_limit)


def pairs_from(counts: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``spillover_pairs`` from stored ``place_time_counts``."""
    found = following(counts, counts, "corridor", S.SPILL_KM, S.PAIR_WINDOW_SEC, True, pair_limit)
    return (
        found.filter(F.col("p_corridor") != F.col("corridor"))
        .groupBy(F.col("corridor").alias("src"), F.col("p_corridor").alias("dst"))
        .agg(F.sum("p_n").alias("count"))
    )


def spillover_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lift of each ordered corridor pair over the base rate of its target."""
    source = pairs.groupBy("src").agg(F.sum("count").alias("src_total"))
    total = nodes.agg(F.sum("n").alias("n")).scalar()
    base = nodes.select(F.col("corridor").alias("dst"), (F.col("n") / total).alias("base"))
    return (
        pairs.filter(F.col("count") >= S.EDGE_MIN_COUNT)
        .join(source, "src")
        .join(base, "dst")
        .select(
            "src", "dst", "count", round_half_even(F.col("count") / F.col("src_total") / F.col("base"), 2).alias("lift")
        )
    )


def blast_radius(edges: DataFrame) -> DataFrame:
    """The strongest downstream corridors of each source with lift above chance."""
    strongest = Window.partitionBy("src").orderBy(F.desc("lift"), "dst")
    return (
        edges.filter(F.col("lift") > S.BLAST_MIN_LIFT)
        .withColumn("rank", F.row_number().over(strongest))
        .filter(F.col("rank") <= S.BLAST_TOP)
        .select("src", "dst", "rank", "lift")
    )


def diversion(nodes: DataFrame, blast: DataFrame) -> DataFrame:
    """The nearest corridors outside the blast radius, closer than the limit.

    Only corridors within the limit are paired; taking the nearest of those equals
    taking the nearest of all and dropping the ones beyond it.
    """
    place = nodes.select(F.col("corridor").alias("src"), "lat", "lon")
    other = nodes.select(F.col("corridor").alias("dst"), "lat", "lon")
    near = distance_pairs(place, other, S.DIVERSION_KM, strict=True).filter(F.col("src") != F.col("dst"))
    nearest = Window.partitionBy("src").orderBy("km", "dst")
    return (
        near.join(blast.select("src", "dst"), ["src", "dst"], "left_anti")
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= S.DIVERSION_TOP)
        .select("src", "dst", "rank", round_half_even(F.col("km"), 1).alias("km"))
    )


def cascade_totals(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Direct impact, impact of follow-ons at the mean of their corridor, and the sum.

    Values are in thousands of congestion-minutes.
    """
    mean = nodes.select(F.col("corridor").alias("dst"), (F.col("load") / F.col("n")).alias("mean"))
    # Fixed-point terms keep the sum independent of the order of rows.
    term = F.rint(F.col("count") * F.col("mean") * F.lit(1e4)).cast("long")
    derived = (
        pairs.join(mean, "dst")
        .groupBy(F.col("src").alias("corridor"))
        .agg((F.sum(term).cast("double") / 1e4).alias("casc"))
    )
    casc = F.coalesce("casc", F.lit(0.0))
    total = F.col("load") + casc
    return nodes.join(derived, "corridor", "left").select(
        "corridor",
        round_half_even(F.col("load") / 1000, 1).alias("direct"),
        round_half_even(casc / 1000, 1).alias("cascaded"),
        round_half_even(total / 1000, 1).alias("total"),
        F.when(F.col("load") != 0, round_half_even(F.try_divide(total, F.col("load")), 2))
        .otherwise(1.0)
        .alias("amplify"),
    )


def top_edges(edges: DataFrame, top: int = 12) -> DataFrame:
    return edges.orderBy(F.desc("lift"), "src", "dst").limit(top)


class Network:
    """The network tables of one log, each computed once and reused by the next."""

    def __init__(self, enriched: DataFrame):
        counts = cut(corridor_counts(enriched))
        self.nodes = sized(nodes_from(counts))
        timed = counts.filter(F.col("t_s").isNotNull()).select(*PLACE_TIME, "corridor", "n")
        self.pairs = cut(pairs_from(timed.join(self.nodes.select("corridor"), "corridor", "left_semi")))

    @property
    def edges(self) -> DataFrame:
        return spillover_edges(self.pairs, self.nodes)

    @property
    def blast(self) -> DataFrame:
        return blast_radius(self.edges)

    @property
    def diversion(self) -> DataFrame:
        return diversion(self.nodes, self.blast)

    @property
    def cascade(self) -> DataFrame:
        return cascade_totals(self.nodes, self.pairs)
