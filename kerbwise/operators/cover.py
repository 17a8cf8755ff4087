"""Greedy maximum coverage over weighted cells, in rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import distance_pairs, haversine_km, nearest
from kerbwise.functions.numbers import round_half_even, tenths
from kerbwise.operators.surface import CELL
from kerbwise.session import cut

# Weights are held as whole millionths. Gains are then exact sums, and neither a
# pick nor a tie depends on how the cells are partitioned.
WEIGHT_SCALE = 1_000_000
# Cells of all partitions, and pairs of cells in reach, up to which a task places all units of a partition. Beyond
# them every unit is a round over all tasks. The picks are the same.
TASK_CELLS, TASK_PAIRS = 100_000, 1_000_000


def cells_in_reach(cells: DataFrame, km: float, strict: bool = False) -> DataFrame:
    """Ordered pairs of cells (self included) no further apart than ``km``."""
    left = cells.select(F.col("gy").alias("gy_i"), F.col("gx").alias("gx_i"), "lat", "lon")
    right = cells.select(F.col("gy").alias("gy_j"), F.col("gx").alias("gx_j"), "lat", "lon")
    return distance_pairs(left, right, km, strict).select("gy_i", "gx_i", "gy_j", "gx_j", "km")


def greedy_cover(
    cells: DataFrame,
    parts: Sequence[str],
    units: int,
    reach_km: float = S.REACH_KM,
    minsep_km: float = 0.0,
    order: Sequence[Column] | None = None,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """Pick ``units`` cells per partition, each adding the most uncovered weight.

    ``cells`` has the partition columns, ``gy``, ``gx``, ``lat``, ``lon`` and a
    non-negative ``w``; a cell has the same position in every partition. Ties go to
    the first cell by ``order`` (default ``gy, gx``). Returns one row per pick:
    partition, ``k``, cell, position, ``covers`` and ``total`` weight.

    Up to ``task_cells`` cells, as a city has them, each partition is placed by one task, all in one job. Beyond, all
    partitions advance together, so there are ``units`` rounds however many
    partitions there are. Gains are kept from round to round: a pick takes weight from
    the cells within reach of it, and only cells within reach of those lose gain. A
    round therefore moves one pick per partition and the few cells around it; the cells
    themselves are updated where they lie and never shuffled after the first gains. Its state is
    written to the shared checkpoint folder, which keeps the plan of the next round short.
    """
    if not parts:
        whole = greedy_cover(cells.withColumn("_whole", F.lit(0)), ["_whole"], units, reach_km, minsep_km, order, task_cells)
        return whole.drop("_whole")
    parts = list(parts)
    order = order or [F.col("gy"), F.col("gx")]
    places = cells.select(*CELL, "lat", "lon").distinct()
    near = cut(cells_in_reach(places, reach_km))
    weight = F.rint(F.col("w") * F.lit(float(WEIGHT_SCALE))).cast("long")
    weighted = cut(cells.select(*parts, *CELL, "lat", "lon", weight.alias("w"), F.struct(*order).alias("ord")))
    size = weighted.agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("known")).first()
    if minsep_km <= reach_km and size["n"] == size["known"] and size["n"] <= task_cells and near.count() <= TASK_PAIRS:
        return _placed_in_tasks(weighted, near, parts, units, minsep_km)
    near = near.drop("km")
    state = cut(
        weighted.join(_within_reach(weighted, near, parts, "w", "offer"), [*parts, *CELL]).withColumns(
            {
                "left": F.col("w"),
                "open": F.lit(True),
                "k": F.lit(None).cast("int"),
                "gain": F.lit(None).cast("long"),
            }
        )
    )
    covered = haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    taken = (F.col("gy") == F.col("p_gy")) & (F.col("gx") == F.col("p_gx"))
    for round_no in range(1, units + 1):
        # One row per partition: weekdays, or events from the rule table x weekdays.
        pick = F.broadcast(_next_pick(state, parts))
        newly = state.join(pick, parts).filter((covered <= reach_km) & (F.col("left") > 0)).select(*parts, *CELL, "left")
        # Distinct grid cells within one and two times the reach of a pick: their number follows from the grid alone.
        loss = F.broadcast(_within_reach(F.broadcast(newly), near, parts, "left", "loss"))
        state = cut(
            state.join(pick, parts, "left").join(loss, [*parts, *CELL], "left").select(
                *parts, *CELL, "lat", "lon", "w", "ord",
                F.when(covered <= reach_km, F.lit(0)).otherwise(F.col("left")).cast("long").alias("left"),
                (F.col("open") & ~F.coalesce(taken | (covered < minsep_km), F.lit(False))).alias("open"),
                F.when(taken, F.lit(round_no)).otherwise(F.col("k")).alias("k"),
                F.when(taken, F.col("p_gain")).otherwise(F.col("gain")).alias("gain"),
                (F.col("offer") - F.coalesce("loss", F.lit(0))).alias("offer"),
            )
        )
    totals = state.groupBy(*parts).agg(F.sum("w").alias("total"))
    scale = float(WEIGHT_SCALE)
    return state.filter(F.col("k").isNotNull()).join(totals, parts).select(
        *parts, "k", *CELL, "lat", "lon",
        (F.col("gain") / F.lit(scale)).alias("covers"),
        (F.col("total") / F.lit(scale)).alias("total"),
    )


def _placed_in_tasks(weighted: DataFrame, near: DataFrame, parts: list[str], units: int, minsep_km: float) -> DataFrame:
    """``greedy_cover`` with a task per partition. Every cell carries the few cells in its reach."""
    lists = near.groupBy(F.col("gy_i").alias("gy"), F.col("gx_i").alias("gx")).agg(
        F.collect_list(F.struct("gy_j", "gx_j", "km")).alias("reach")
    )
    lists = lists.select(*CELL, *[F.col(f"reach.{c}").alias(c) for c in ("gy_j", "gx_j", "km")])
    first = Window.partitionBy(*parts).orderBy("ord")
    listed = weighted.withColumn("at", F.row_number().over(first)).drop("ord").join(lists, CELL).dropna(subset=parts)
    scale, none = float(WEIGHT_SCALE), F.lit(None)
    schema = listed.select(*parts, none.cast("int").alias("k"), *CELL, "lat", "lon", none.cast("long").alias("gain"), none.cast("long").alias("total")).schema
    found = listed.groupBy(*parts).applyInArrow(_placement(schema.names, units, minsep_km), schema)
    return found.withColumns({c: F.col(c) / F.lit(scale) for c in ("gain", "total")}).withColumnRenamed("gain", "covers")


def _placement(names: list[str], units: int, minsep_km: float) -> Callable[[pa.Table], pa.Table]:
    """All picks of one partition, round after round."""

    def run(cells: pa.Table) -> pa.Table:
        own = np.stack([cells[c].to_numpy() for c in CELL], axis=1)
        there = np.stack([pc.list_flatten(cells[f"{c}_j"]).to_numpy() for c in CELL], axis=1)
        code = np.unique(np.concatenate([own, there]), axis=0, return_inverse=True)[1].reshape(-1)
        own, there = code[: len(own)], code[len(own) :]
        here = np.repeat(np.arange(len(own)), pc.list_value_length(cells["km"]).to_numpy())
        # A cell in reach is as many rows as it has in this partition.
        by_code = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[by_code], there, "left"), np.searchsorted(own[by_code], there, "right")
        times = high - low
        row, km = np.repeat(here, times), np.repeat(pc.list_flatten(cells["km"]).to_numpy(), times)
        other = by_code[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        starts = np.searchsorted(row, np.arange(len(own) + 1))
        weight, at = cells["w"].to_numpy(), cells["at"].to_numpy()
        offer = np.zeros(len(own), np.int64)
        np.add.at(offer, row, weight[other])
        left, free = weight.copy(), np.ones(len(own), bool)
        picked, gain = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        for k in range(1, units + 1):
            if not free.any():
                break
            best = np.flatnonzero(free & (offer == offer[free].max()))
            pick = best[at[best].argmin()]
            taken, around = own == own[pick], slice(starts[pick], starts[pick + 1])
            picked[taken], gain[taken] = k, offer[pick]
            free[taken] = False
            free[other[around][km[around] < minsep_km]] = False
            for r in other[around]:
                if left[r] > 0:
                    np.subtract.at(offer, other[starts[r] : starts[r + 1]], left[r])
            left[other[around]] = 0
        total = np.full(len(own), weight.sum())
        out = cells.append_column("k", pa.array(picked)).append_column("gain", pa.array(gain)).append_column("total", pa.array(total))
        return out.filter(pa.array(picked > 0)).select(names)

    return run


def _within_reach(cells: DataFrame, near: DataFrame, parts: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the given cells in reach of each cell of the same partition."""
    met = cells.select(*parts, F.col("gy").alias("gy_j"), F.col("gx").alias("gx_j"), value).join(near, ["gy_j", "gx_j"])
    return met.groupBy(*parts, F.col("gy_i").alias("gy"), F.col("gx_i").alias("gx")).agg(F.sum(value).alias(name))


def _next_pick(state: DataFrame, parts: list[str]) -> DataFrame:
    """The open cell with the largest gain per partition: at most one row each."""
    best = F.min_by(F.struct(*CELL, "lat", "lon", "offer"), F.struct(-F.col("offer"), F.col("ord"))).alias("b")
    return state.filter(F.col("open")).groupBy(*parts).agg(best).filter(F.col("b").isNotNull()).select(
        *parts,
        F.col("b.gy").alias("p_gy"), F.col("b.gx").alias("p_gx"),
        F.col("b.lat").alias("p_lat"), F.col("b.lon").alias("p_lon"), F.col("b.offer").alias("p_gain"),
    )


def with_coverage(picks: DataFrame, parts: Sequence[str], rounded: bool) -> DataFrame:
    """Running covered share in percent after each pick.

    ``rounded`` sums the gains as reported (one decimal) instead of the raw gains.
    """
    gain = round_half_even(F.col("covers"), 1) if rounded else F.col("covers")
    fixed = F.rint(gain * F.lit(float(WEIGHT_SCALE))).cast("long")
    running = Window.partitionBy(*parts).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(fixed).over(running) / F.lit(float(WEIGHT_SCALE)) / (F.col("total") + F.lit(1e-9))
    return picks.withColumn("cum_coverage_pct", round_half_even(F.lit(100.0) * share, 1))


def preposition(
    cells: DataFrame, units: int = S.UNITS, dow: int | None = None, cell_dow: DataFrame | None = None
) -> DataFrame:
    """City-wide anchors without separation; weights per day or of one weekday."""
    if dow is not None and cell_dow is not None:
        day = cell_dow.filter(F.col("dow") == dow).select(*CELL, F.col("exp_impact_per_day").alias("w"))
        weighted = cells.join(day, CELL)
    else:
        weighted = cells.withColumn("w", F.col("exp_impact_per_day"))
    weighted = cut(weighted.filter(F.col("w") > 0).select(*CELL, "lat", "lon", "w", "impact", "top_corridor"))
    picks = greedy_cover(weighted, [], units, order=[-F.col("impact"), F.col("gy"), F.col("gx")])
    named = picks.join(weighted.select(*CELL, F.col("top_corridor").alias("anchor_corridor")), CELL)
    return with_coverage(named, [], rounded=True).select(
        "k", *CELL, "lat", "lon", "anchor_corridor",
        round_half_even(F.col("covers"), 1).alias("covers"), "cum_coverage_pct",
    )


def busiest_weekday(cell_dow: DataFrame) -> int | None:
    """The weekday with the largest total impact, the earlier one of equals; None without any."""
    total = cell_dow.groupBy("dow").agg(F.sum(tenths(F.col("sum_impact"))).alias("t"))
    first = total.orderBy(F.desc("t"), "dow").select("dow").first()
    return first["dow"] if first else None


def preposition_busiest(cells: DataFrame, cell_dow: DataFrame, units: int = S.UNITS) -> DataFrame:
    """City-wide anchors for the busiest weekday, with that weekday."""
    cell_dow = cut(cell_dow)
    dow = busiest_weekday(cell_dow)
    return preposition(cells, units, -1 if dow is None else dow, cell_dow).withColumn("dow", F.lit(dow).cast("int"))


def deploy_by_dow(risk: DataFrame, units: int = S.UNITS, minsep_km: float = S.PLAN_MINSEP_KM) -> DataFrame:
    """Anchors for every weekday in one run, at least ``minsep_km`` apart."""
    weighted = cut(risk.filter(F.col("exp_impact") > 0).withColumnRenamed("exp_impact", "w"))
    picks = greedy_cover(weighted, ["dow"], units, minsep_km=minsep_km)
    return with_coverage(picks, ["dow"], rounded=True).select(
        "dow", "k", *CELL,
        round_half_even(F.col("lat"), 5).alias("lat"), round_half_even(F.col("lon"), 5).alias("lon"),
        round_half_even(F.col("covers"), 1).alias("covers"), "cum_coverage_pct",
    )


def plan_coverage(plan: DataFrame) -> DataFrame:
    """Coverage of each weekday's whole plan."""
    return plan.groupBy("dow").agg(F.max_by("cum_coverage_pct", "k").alias("coverage_pct"))


def coverage_curve(cells: DataFrame, units: int = S.CURVE_UNITS) -> DataFrame:
    """Covered share after each added unit."""
    weighted = cut(
        cells.withColumn("w", F.col("exp_impact_per_day"))
        .filter(F.col("w") > 0)
        .select(*CELL, "lat", "lon", "w", "impact")
    )
    picks = greedy_cover(
        weighted, [], units, minsep_km=S.CURVE_MINSEP_KM, order=[-F.col("impact"), F.col("gy"), F.col("gx")]
    )
    return with_coverage(picks, [], rounded=False).select(
        "k", *CELL,
        round_half_even(F.col("lat"), 5).alias("lat"), round_half_even(F.col("lon"), 5).alias("lon"),
        round_half_even(F.col("covers"), 1).alias("covers"), "cum_coverage_pct",
    )


def marginal_units(curve: DataFrame, shares: Sequence[int] = (50, 70, 80)) -> DataFrame:
    """Units needed for each coverage target; all placed units if none suffices."""
    return curve.agg(
        *[
            F.coalesce(F.min(F.when(F.col("cum_coverage_pct") >= p, F.col("k"))), F.max("k")).alias(f"u_for_{p}")
            for p in shares
        ]
    )


def event_points(scenarios: DataFrame, pins: Sequence[tuple[str, float, float, float]] = ()) -> DataFrame:
    """Event archetypes and given points as ``(scenario, lat, lon, bump)`` rows."""
    points = scenarios.select(F.col("name").alias("scenario"), "lat", "lon", "bump")
    if pins:
        literal = F.array(
            *[
                F.struct(
                    F.lit(name).alias("scenario"), F.lit(float(lat)).alias("lat"),
                    F.lit(float(lon)).alias("lon"), F.lit(float(bump)).alias("bump"),
                )
                for name, lat, lon, bump in pins
            ]
        )
        given = scenarios.sparkSession.range(1).select(F.explode(literal).alias("p")).select("p.*")
        points = points.unionByName(given)
    return points


def event_bump(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Extra weight per (event, cell): all cells within the radius of the event, or
    the nearest cell if there is none (of equals that of smaller latitude, then longitude).

    Cells within the radius come from the bucketed distance join; only events without one
    go through the pyramid of boxes for their nearest cell. No event meets every cell.
    """
    events = cut(events)
    places = cells.select(*CELL, "lat", "lon")
    inside = cut(distance_pairs(events, places, S.EVENT_RADIUS_KM).select("scenario", *CELL, "bump"))
    lost = cut(events.join(inside.select("scenario").distinct(), "scenario", "left_anti"))
    if lost.isEmpty():
        return inside
    return inside.unionByName(nearest(lost, places, ["scenario"]).select("scenario", *CELL, "bump"))


def scenario_sweep(
    risk: DataFrame, events: DataFrame, units: int = S.SWEEP_UNITS, min_units: int = 2
) -> DataFrame:
    """Coverage for every (event, weekday, number of units) and the change against no event.

    A greedy run with more units starts with the picks of a run with fewer, so one
    run of ``units`` rounds answers every smaller number.
    """
    risk = cut(
        risk.select(
            *CELL, round_half_even(F.col("lat"), 5).alias("lat"), round_half_even(F.col("lon"), 5).alias("lon"),
            "dow", round_half_even(F.col("exp_impact"), 1).alias("w"),
        )
    )
    events = cut(events)
    places = risk.select(*CELL, "lat", "lon").distinct()
    dense = places.withColumn("dow", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(
        risk.select(*CELL, "dow", "w"), [*CELL, "dow"], "left"
    )
    # One name per rule of the rule table and per given point, whatever the size of the log.
    names = events.agg(F.collect_list("scenario").alias("s")).scalar()
    scenarios = F.explode(F.concat(F.array(F.lit("base")), names))
    bumped = (
        dense.withColumn("scenario", scenarios)
        .join(event_bump(places, events), ["scenario", *CELL], "left")
        .withColumn("w", F.coalesce("w", F.lit(0.0)) + F.coalesce("bump", F.lit(0.0)))
        .drop("bump")
    )
    parts = ["scenario", "dow"]
    picks = greedy_cover(
        bumped, parts, units, minsep_km=S.PLAN_MINSEP_KM, order=[F.col("lat"), F.col("lon"), F.col("gy"), F.col("gx")]
    )
    covered = with_coverage(picks, parts, rounded=False).filter(F.col("k") >= min_units)
    base = Window.partitionBy("dow", "k")
    plain = F.max(F.when(F.col("scenario") == "base", F.col("cum_coverage_pct"))).over(base)
    return covered.select(
        *parts, "k", *CELL, "cum_coverage_pct",
        round_half_even(F.col("cum_coverage_pct") - plain, 1).alias("change_pct"),
    )
