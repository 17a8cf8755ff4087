"""Time-and-distance neighbours counted without writing out pairs of incidents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import KM_PER_DEGREE, bucket_degrees
from kerbwise.session import cut, shuffled, sized

PLACE_TIME = ["t_s", "lat", "lon"]
A_BOX = ["bt", "by", "bx"]
P_BOX = ["p_bt", "p_by", "p_bx"]
# Sides of the largest boxes, in windows and in radii.
SLAB, SIDE = 16, 2
# Product of row counts, and rows of either side, up to which two neighbouring boxes are compared
# in one task; beyond them they are halved. Neither these nor the last level changes any result;
# they only choose how it is computed.
PAIR_LIMIT = 10_000_000_000
ROW_LIMIT = 1_000_000
# Halving days and kilometres this often ends below one second and one metre, where a
# box holds single places.
MAX_LEVEL = 17
# Anchors and points that are compared at a time within a task.
ANCHOR_BLOCK, POINT_BLOCK = 128, 16_384
# Cosines closer to that of the radius than this are decided by the distance formula. Rounding is below 1e-15.
COSINE_SLACK = 1e-14


def place_time_counts(df: DataFrame, label: str) -> DataFrame:
    """Incidents counted per (second, place, label).

    Copies of one incident, however many, become a single row with a weight before
    anything is joined, and a place that holds a large share of the log is reduced to
    its distinct seconds: at most one row per second of the window and label, whatever
    the size of the log. Incidents without a time take no part.
    """
    return (
        df.filter(F.col("t_event").isNotNull())
        .groupBy(F.unix_seconds("t_event").alias("t_s"), "lat", "lon", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def following(
    anchors: DataFrame,
    points: DataFrame,
    label: str,
    km: float,
    seconds: int,
    per_label: bool = False,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Anchors ``(t_s, lat, lon)`` with the number ``p_n`` of points per ``p_<label>`` that follow them
    within ``seconds`` and ``km``. To be summed by the caller; an anchor and a label
    may occur on several rows.

    Both sides carry ``t_s``, ``lat``, ``lon``; points also ``label`` and a weight ``n``. A point may not be
    earlier than its anchor. With ``per_label`` anchors carry ``label`` and ``n`` too and their counts are
    summed per label, each anchor ``n`` times: rows are ``(label, p_<label>, p_n)``. Of two rows of one
    second then the one with the smaller label is the anchor; rows of one second and label are no pair.

    Space-time is cut into boxes some windows long and two radii wide. An anchor lies in one box and a point
    is offered to those it can follow, so a box meets its points in one task, which compares them a block
    at a time in order of time. Where two neighbouring boxes hold more than ROW_LIMIT rows, or the product of
    their row counts exceeds ``pair_limit``, both are halved along every side, repeatedly:
    sub-boxes that lie entirely within reach of each other contribute their counts,
    those entirely out of reach are dropped, and only what remains on the rim is
    compared. A box that holds much of the log is thus counted, not paired.
    """
    sizes, reach, heavy, any_heavy = _boxes(anchors, points, km, seconds, pair_limit)
    own = [label] if per_label else PLACE_TIME
    others = points.select(*[F.col(c).alias(f"p_{c}") for c in ("t_s", "lat", "lon", label, "n")])
    kinds = dict(anchors.dtypes) | dict(others.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*own, f"p_{label}", "p_n"))
    compare = _comparison(label, km, seconds, per_label)

    def compared(here: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
        return here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(compare, schema)

    offered = _offer_points(_boxed(others, "p_", sizes, 0), sizes, reach)
    if any_heavy:
        offered = offered.join(heavy, A_BOX + P_BOX, "left_anti")
    found = compared(_boxed(anchors, "", sizes, 0), offered, A_BOX)
    level = 0
    while any_heavy:
        level += 1
        parents = heavy.select(*[F.col(c).alias(f"up_{c}") for c in A_BOX + P_BOX])
        halves = parents.join(shuffled(_box_counts(anchors, sizes, level, "a")), [f"up_{c}" for c in A_BOX]).join(
            shuffled(_box_counts(points, sizes, level, "p")), [f"up_{c}" for c in P_BOX]
        )
        inside, outside = _relation(sizes, level, km, seconds)
        pairs = cut(
            halves.filter(~outside).select(*A_BOX, *P_BOX, inside.alias("inside"), _crowded(pair_limit).alias("crowded"))
        )
        here, there = _boxed(anchors, "", sizes, level), _boxed(others, "p_", sizes, level)
        counts = there.groupBy(*P_BOX, f"p_{label}").agg(F.sum("p_n").alias("p_n"))
        within = pairs.filter(F.col("inside"))
        whole = shuffled(within).join(counts, P_BOX).groupBy(*A_BOX, f"p_{label}").agg(F.sum("p_n").alias("p_n"))
        if per_label:
            weights = here.groupBy(*A_BOX, label).agg(F.sum("n").alias("n"))
            whole = shuffled(weights).join(whole, A_BOX).groupBy(*own, f"p_{label}").agg(F.sum(F.col("n") * F.col("p_n")).alias("p_n"))
        else:
            whole = shuffled(here).join(whole, A_BOX).select(*own, f"p_{label}", "p_n")
        rim = pairs.filter(~F.col("inside"))
        boxes = (rim if level == MAX_LEVEL else rim.filter(~F.col("crowded"))).select(*A_BOX, *P_BOX)
        # Keyed by the pair of boxes, so a box on the rim of many others is not one task.
        light = compared(shuffled(here).join(boxes, A_BOX), shuffled(there).join(boxes, P_BOX), A_BOX + P_BOX)
        found = found.unionByName(whole).unionByName(light)
        heavy = rim.filter(F.col("crowded"))
        any_heavy = level < MAX_LEVEL and not heavy.isEmpty()
    return found


def _boxes(
    anchors: DataFrame, points: DataFrame, km: float, seconds: int, pair_limit: int
) -> tuple[tuple[float, float, float], tuple[float, float, float], DataFrame, bool]:
    """Sides and reach of the largest boxes, the neighbouring ones that are too crowded for a task, and whether there are any."""
    # The box width holds for the highest latitude that occurs; one number from stored counts.
    latitude = points.agg(F.max(F.abs("lat"))).first()[0]
    height, width = bucket_degrees(km, latitude or 0.0)
    sizes = (float(seconds * SLAB), height * SIDE, width * SIDE)
    heavy = sized(_heavy_neighbours(anchors, points, sizes, pair_limit))
    return sizes, (float(seconds), height, width), heavy, not heavy.isEmpty()


def surroundings(
    anchors: DataFrame, points: DataFrame, label: str, km: float, seconds: int, marked: tuple[str, ...], pair_limit: int = PAIR_LIMIT
) -> DataFrame | None:
    """Per anchor of ``following`` one row: number of its points ``size``, of their labels ``mix``, count ``dom_n`` and name
    ``dom_<label>`` of the most frequent (of equals the smallest), and whether a label is one of ``marked``: ``live``.

    A box sees all points of its anchors, so they are summed up where they are compared, and no row per label moves. None
    if any box is too crowded for that.
    """
    sizes, reach, _, any_heavy = _boxes(anchors, points, km, seconds, pair_limit)
    if any_heavy:
        return None
    others = points.select(*[F.col(c).alias(f"p_{c}") for c in ("t_s", "lat", "lon", label, "n")])
    offered = _offer_points(_boxed(others, "p_", sizes, 0), sizes, reach)
    kinds = dict(anchors.dtypes) | dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in PLACE_TIME), "size long, mix long, dom_n long", f"`dom_{label}` {kinds[label]}", "live boolean"])
    compare = _comparison(label, km, seconds, False, marked)
    here = _boxed(anchors.select(*PLACE_TIME), "", sizes, 0)
    return here.groupBy(*A_BOX).cogroup(offered.groupBy(*A_BOX)).applyInArrow(compare, schema)


def _comparison(label: str, km: float, seconds: int, per_label: bool, marked: tuple[str, ...] | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``following`` for the anchors and points of one box; with ``marked`` the figures of ``surroundings``."""

    def figures(anchors: pa.Table, blocks: Iterator[tuple[np.ndarray, np.ndarray]], names: pa.Array) -> pa.Table:
        among, known = (np.array(x.to_pylist(), bool) for x in (pc.is_in(names, pa.array(marked, names.type)), pc.is_valid(names)))
        parts = [(np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),) * 2]
        for rows, sums in blocks:
            rows, sums = rows[some := sums.any(axis=1)], sums[some]
            # Names are in order, so the first of the largest counts has the smallest. Null takes no part in ``live``.
            code = sums.argmax(axis=1)
            most = sums[np.arange(len(rows)), code]
            parts.append((rows, sums.sum(axis=1), np.count_nonzero(sums, axis=1), most, code, sums[:, among & known].any(axis=1), ~sums[:, known].any(axis=1)))
        rows, size, mix, most, code, live, unknown = (np.concatenate(x) for x in zip(*parts))
        found = {c: anchors[c].take(pa.array(rows)) for c in PLACE_TIME} | {"size": size, "mix": mix, "dom_n": most}
        return pa.table(found | {f"dom_{label}": names.take(pa.array(code)), "live": pa.array(live, mask=unknown)})

    def run(anchors: pa.Table, points: pa.Table) -> pa.Table:
        names, (a_code, p_code) = label_codes(anchors[label] if per_label else None, points[f"p_{label}"])
        a_t, p_t = anchors["t_s"].to_numpy(), points["p_t_s"].to_numpy()
        a_order, p_order = np.lexsort((a_code, a_t)) if per_label else np.argsort(a_t, kind="stable"), np.lexsort((p_code, p_t))
        sides = []
        for table, prefix, order in ((anchors, "", a_order), (points, "p_", p_order)):
            sides.append([table[f"{prefix}{c}"].to_numpy()[order] for c in ("t_s", "lat", "lon")])
        p_code, weight = p_code[p_order], points["p_n"].to_numpy()[p_order]
        codes, times = max(1, len(names)), sides[0][0]
        if per_label:  # points are ordered by second and label: those up to the anchor's own come before
            first = np.searchsorted(sides[1][0] * codes + p_code, times * codes + a_code[a_order], "right")
        else:
            first = np.searchsorted(sides[1][0], times, "left")
        last = np.maximum(first, np.searchsorted(sides[1][0], times + seconds, "right"))
        rows, labels, counts = [], [], []
        if marked is not None:
            blocks = near_sums(*sides, first, last, p_code, weight, codes, km)
            return figures(anchors, ((a_order[block], sums) for block, sums in blocks), names)
        total = np.zeros((codes, codes) if per_label else (0, 0), np.int64)
        for block, sums in near_sums(*sides, first, last, p_code, weight, codes, km):
            if per_label:
                np.add.at(total, a_code[a_order[block]], sums * anchors["n"].to_numpy()[a_order[block], None])
            else:
                row, code = np.nonzero(sums)
                rows.append(a_order[block][row])
                labels.append(code)
                counts.append(sums[row, code])
        if per_label:
            row, code = np.nonzero(total)
            return pa.table({label: names.take(pa.array(row)), f"p_{label}": names.take(pa.array(code)), "p_n": total[row, code]})
        row, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, labels))
        found = {c: anchors[c].take(pa.array(row)) for c in PLACE_TIME}
        return pa.table(found | {f"p_{label}": names.take(pa.array(code)), "p_n": np.concatenate(counts) if counts else code})

    return run


def label_codes(*columns: pa.ChunkedArray | None) -> tuple[pa.Array, list[np.ndarray | None]]:
    """The different labels in order, and the number of each label in every column."""
    names = pc.unique(pa.chunked_array([chunk for c in columns if c is not None for chunk in c.chunks], columns[-1].type))
    names = names.take(pc.sort_indices(names, null_placement="at_start"))
    return names, [None if c is None else pc.index_in(c, names).to_numpy().astype(np.int64) for c in columns]


def near_sums(anchors, points, first, last, codes, weights, n_codes, km) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of some anchors, and for each the weights by code of its points ``first`` to ``last`` within ``km``.

    Distances are compared as cosines of unit vectors; those next to the radius by the distance formula.
    """
    a, p = _unit_vectors(*anchors[1:]), _unit_vectors(*points[1:])
    limit = np.cos(min(km / S.EARTH_RADIUS_KM, np.pi))
    for start in range(0, len(a), ANCHOR_BLOCK):
        block = np.arange(start, min(start + ANCHOR_BLOCK, len(a)))
        low, high = first[block, None], last[block, None]
        sums = np.zeros((len(block), n_codes), np.int64)
        for begin in range(low.min(), high.max(), POINT_BLOCK):
            # in order of codes, so that each code is one run of columns
            at = np.arange(begin, min(begin + POINT_BLOCK, high.max()))
            at = at[np.argsort(codes[at], kind="stable")]
            cosine = a[block] @ p[at].T
            near, maybe = cosine > limit + COSINE_SLACK, cosine >= limit - COSINE_SLACK
            if np.count_nonzero(near) != np.count_nonzero(maybe):
                i, j = np.nonzero(near != maybe)
                near[i, j] = _distances(anchors, block[i], points, at[j]) <= km
            near &= (at >= low) & (at < high)
            runs = np.flatnonzero(np.diff(codes[at], prepend=-1))
            sums[:, codes[at[runs]]] += np.add.reduceat(near * weights[at], runs, axis=1)
        yield block, sums


def _unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _distances(anchors, i, points, j) -> np.ndarray:
    """``haversine_km`` of single pairs."""
    (lat1, lon1), (lat2, lon2) = (x[i] for x in anchors[1:]), (x[j] for x in points[1:])
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    chord = np.sin(half_lat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lon) * np.sin(half_lon)
    return 2 * S.EARTH_RADIUS_KM * np.arcsin(np.sqrt(chord))


def _boxed(df: DataFrame, prefix: str, sizes: tuple[float, float, float], level: int) -> DataFrame:
    """Add the box of each row; sides are halved once per level, exactly."""
    names = P_BOX if prefix else A_BOX
    sources = [f"{prefix}{c}" for c in PLACE_TIME]
    return df.withColumns(
        {n: F.floor(F.col(c) / F.lit(size / 2**level)) for n, c, size in zip(names, sources, sizes)}
    )


def _offer_points(boxed: DataFrame, sizes: tuple[float, float, float], reach: tuple[float, float, float]) -> DataFrame:
    """Points offered to every box that may hold an anchor they follow."""
    axes = list(zip(A_BOX, PLACE_TIME, sizes, reach))
    for box, c, size, far in axes:
        ahead = F.col(f"p_{c}") if c == "t_s" else F.col(f"p_{c}") + F.lit(far)
        ends = [F.floor(x / F.lit(size)) for x in (F.col(f"p_{c}") - F.lit(far), ahead)]
        boxed = boxed.withColumn(box, F.explode(F.sequence(*ends)))
    return boxed


def _offer(boxed: DataFrame) -> DataFrame:
    """Boxes of points with the anchor boxes around: their own and the previous in time, nine squares."""
    around = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.lit(y).alias("y"), F.lit(x).alias("x"))
            for t in (0, -1) for y in (-1, 0, 1) for x in (-1, 0, 1)
        ]
    )
    stepped = boxed.withColumn("_s", F.explode(around))
    return stepped.withColumns(
        {a: F.col(p) + F.col(f"_s.{axis}") for a, p, axis in zip(A_BOX, P_BOX, ("t", "y", "x"))}
    ).drop("_s")


def _box_counts(df: DataFrame, sizes: tuple[float, float, float], level: int, side: str) -> DataFrame:
    """Rows per box, with the box one level up."""
    names = A_BOX if side == "a" else P_BOX
    boxes = _boxed(df.select(*PLACE_TIME), "", sizes, level).withColumnsRenamed(dict(zip(A_BOX, names)))
    counted = boxes.groupBy(*names).agg(F.count(F.lit(1)).alias(f"{side}_n"))
    return counted.withColumns({f"up_{c}": F.floor(F.col(c) / F.lit(2)) for c in names})


def _heavy_neighbours(
    anchors: DataFrame, points: DataFrame, sizes: tuple[float, float, float], pair_limit: int
) -> DataFrame:
    """Neighbouring boxes whose row counts multiply to more than the limit."""
    here = _box_counts(anchors, sizes, 0, "a").select(*A_BOX, "a_n")
    there = _box_counts(points, sizes, 0, "p").select(*P_BOX, "p_n")
    return shuffled(here).join(_offer(there), A_BOX).filter(_crowded(pair_limit)).select(*A_BOX, *P_BOX)


def _crowded(pair_limit: int) -> Column:
    """Whether the row counts of two boxes are too many for one task."""
    product = F.col("a_n").cast("double") * F.col("p_n")
    return (product > pair_limit) | (F.greatest("a_n", "p_n") > ROW_LIMIT)


def _relation(
    sizes: tuple[float, float, float], level: int, km: float, seconds: int
) -> tuple[Column, Column]:
    """Whether two boxes of a level lie entirely within or entirely out of reach.

    Both answers are on the safe side of rounding; a box pair in doubt is neither.
    """
    span, height, width = (size / 2**level for size in sizes)
    gap = F.col("p_bt") - F.col("bt")
    south = F.least("by", "p_by") * F.lit(height)
    north = (F.greatest("by", "p_by") + 1) * F.lit(height)
    cosines = (F.cos(F.radians(south)), F.cos(F.radians(north)))
    widest = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(*cosines))
    rows_apart, columns_apart = F.abs(F.col("p_by") - F.col("by")), F.abs(F.col("p_bx") - F.col("bx"))

    def planar(rows: Column, columns: Column, cosine: Column) -> Column:
        y, x = rows * F.lit(height), columns * F.lit(width) * cosine
        return F.lit(KM_PER_DEGREE) * F.sqrt(y * y + x * x)

    farthest = planar(rows_apart + 1, columns_apart + 1, widest) * F.lit(1 + 1e-6)
    none = F.lit(0)
    nearest = planar(F.greatest(rows_apart - 1, none), F.greatest(columns_apart - 1, none), F.least(*cosines))
    inside = (gap >= 1) & ((gap + 1) * F.lit(span) <= seconds) & (farthest <= km)
    outside = (gap < 0) | ((gap - 1) * F.lit(span) > seconds) | (nearest * F.lit(1 - 1e-6) > km)
    return inside, outside


_near_sums = near_sums  # the name it had
