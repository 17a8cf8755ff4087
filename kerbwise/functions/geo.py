"""Grid and distance columns, and the bucketed distance join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.session import cut

KM_PER_DEGREE = S.EARTH_RADIUS_KM * math.pi / 180.0
# Buckets are a little wider than the radius so that rounding in the distance
# formula can never place a partner outside the neighbouring bucket.
BUCKET_MARGIN = 1.0001


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * S.EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def grid_index(coordinate: Column, size: float = S.GRID_DEG) -> Column:
    return F.rint(coordinate / F.lit(size)).cast("int")


def with_grid(df: DataFrame, size: float = S.GRID_DEG) -> DataFrame:
    return df.withColumns({"gy": grid_index(F.col("lat"), size), "gx": grid_index(F.col("lon"), size)})


def bucket_degrees(km: float, latitude: float) -> tuple[float, float]:
    """Bucket height and width in degrees such that ``km`` spans at most one bucket
    anywhere between the two parallels of ``latitude``."""
    height = km / KM_PER_DEGREE * BUCKET_MARGIN
    width = km / (KM_PER_DEGREE * math.cos(math.radians(min(abs(latitude) + height, 89.9)))) * BUCKET_MARGIN
    return height, width


def band_width(band: Column, km: float) -> Column:
    """Bucket width in degrees for a band of latitude (a bucket row) and its neighbours.
    It follows from the band alone, so it holds wherever the data lie."""
    height = F.lit(km / KM_PER_DEGREE * BUCKET_MARGIN)
    farthest = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(89.9))
    return F.lit(km / KM_PER_DEGREE * BUCKET_MARGIN) / F.cos(F.radians(farthest))


def around(band: Column, km: float) -> Column:
    """Number of equal buckets around a band of latitude, none narrower than ``band_width``; one next to a pole."""
    height = F.lit(km / KM_PER_DEGREE * BUCKET_MARGIN)
    polar = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height >= F.lit(89.9)
    return F.when(polar, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / band_width(band, km)))).cast("long")


def distance_pairs(left: DataFrame, right: DataFrame, km: float, strict: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``left`` joined to rows of ``right`` no further than ``km`` away.

    Both sides carry ``lat``/``lon``; the other columns must have distinct names.
    Every left row sits in one bucket and every right row is offered to the nine
    buckets around its own, so that the join is an equi-join and no pair occurs
    twice. Buckets follow the latitude and close around the globe, so that pairs across
    the 180th meridian and the poles are found. Rows must also agree in the columns ``on``,
    which both sides carry. Adds ``km``; the right coordinates are ``lat_r``/``lon_r``.
    """
    height = km / KM_PER_DEGREE * BUCKET_MARGIN
    circle = around(F.col("_by"), km)
    bucketed = left.withColumn("_by", F.floor(F.col("lat") / F.lit(height))).withColumn(
        "_bx", F.pmod(_turn(F.col("lon"), circle), circle)
    )
    bands = F.array(*[F.floor(F.col("lat_r") / F.lit(height)) + F.lit(step) for step in (-1, 0, 1)])
    columns = F.array(*[F.pmod(_turn(F.col("lon_r"), circle) + F.lit(step), circle) for step in (-1, 0, 1)])
    offered = (
        right.withColumnsRenamed({"lat": "lat_r", "lon": "lon_r"})
        .withColumn("_by", F.explode(bands))
        .withColumn("_bx", F.explode(F.array_distinct(columns)))
    )
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_r"), F.col("lon_r"))
    joined = bucketed.join(offered, [*on, "_by", "_bx"]).drop("_by", "_bx").withColumn("km", distance)
    return joined.filter(F.col("km") < km if strict else F.col("km") <= km)


def _turn(lon: Column, circle: Column) -> Column:
    return F.floor((lon + F.lit(180.0)) * circle / F.lit(360.0))


def _reach_degrees(band: Column, height: float, km: float) -> Column:
    """Longitudes that ``km`` can span next to a band of latitude ``height`` degrees high."""
    farthest = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(height), F.lit(89.9))
    chord = F.least(F.lit(1.0), F.lit(math.sin(km / S.EARTH_RADIUS_KM / 2)) / F.cos(F.radians(farthest)))
    return F.degrees(F.asin(chord)) * F.lit(2 * BUCKET_MARGIN)


def reach_boxes(df: DataFrame, km: float, side: float) -> DataFrame:
    """Every row once per box ``(_by, _bx)``, at least ``side`` times ``km`` wide, that may hold a place within ``km`` of it.

    Boxes follow the latitude and close around the globe. ``_own`` marks the box the row lies in.
    """
    reach = km / KM_PER_DEGREE * BUCKET_MARGIN
    height = reach * side
    span = _reach_degrees(F.col("_by"), height, km)
    polar = F.greatest(F.abs(F.col("_by") - 1), F.abs(F.col("_by") + 2)) * F.lit(height) >= F.lit(89.9)
    circle = F.when(polar, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0 / side) / span))).cast("long")

    def column(lon: Column) -> Column:
        return _turn(lon, F.col("_circle"))

    lat, lon = F.col("lat"), F.col("lon")
    turns = F.sequence(column(lon - F.col("_span")), column(lon + F.col("_span")))
    bands = F.sequence(F.floor((lat - reach) / height), F.floor((lat + reach) / height))
    offered = df.withColumn("_by", F.explode(bands)).withColumns({"_span": F.least(span, F.lit(180.0)), "_circle": circle})
    around_globe = F.array_distinct(F.transform(turns, lambda x: F.pmod(x, F.col("_circle"))))
    own = (F.col("_by") == F.floor(lat / height)) & (F.col("_bx") == F.pmod(column(lon), F.col("_circle")))
    return offered.withColumn("_bx", F.explode(around_globe)).withColumn("_own", own).drop("_span", "_circle")


# Places are sorted into a pyramid of boxes: 2 ** 15 steps of latitude and of longitude at
# the bottom, eight times fewer on each level above it.
PYRAMID_BITS = (12, 9, 6, 3, 0)
STEPS = 1 << 15
# Chords are compared with a slack far above rounding and far below a metre.
CHORD_SLACK = 1e-9


def _chord_axes(lat: Column, lon: Column) -> dict[str, Column]:
    """The point on the unit sphere."""
    flat = F.cos(F.radians(lat))
    return {"_x": flat * F.cos(F.radians(lon)), "_y": flat * F.sin(F.radians(lon)), "_z": F.sin(F.radians(lat))}


def nearest(points: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """The nearest of ``places`` for every value of ``by`` among ``points``, anywhere on the globe.

    Both sides carry ``lat``/``lon``; the other columns must have distinct names. Boxes of places are entered from
    the top of a pyramid. On every level a point meets the boxes below those it kept, and keeps those that may hold
    its nearest place: whose least possible chord does not exceed the smallest greatest possible one. So a point meets a
    few boxes per level, however many places there are. Ties go to the smaller latitude, then longitude. Points
    or places without a position are left out. Adds ``lat_r``, ``lon_r`` and ``km``.
    """
    step = {
        "_cy": F.least(F.floor((F.col("lat") + 90.0) / 180.0 * STEPS), F.lit(STEPS - 1)),
        "_cx": F.pmod(F.floor((F.col("lon") + 180.0) / 360.0 * STEPS), F.lit(STEPS)),
    }
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    stored = cut(places.filter(known).withColumns(step | _chord_axes(F.col("lat"), F.col("lon"))))
    axes = ("_x", "_y", "_z")
    spans = [f(a).alias(f"{a}_{f.__name__}") for a in axes for f in (F.min, F.max)]
    bottom = cut(stored.groupBy("_cy", "_cx").agg(*spans))
    asked = points.filter(known).withColumns(_chord_axes(F.col("lat"), F.col("lon")))
    kept = asked.withColumns({"_py": F.lit(0).cast("long"), "_px": F.lit(0).cast("long")})
    own = [*points.columns, *axes]
    for bits in PYRAMID_BITS:
        merged = [f(f"{a}_{f.__name__}").alias(f"{a}_{f.__name__}") for a in axes for f in (F.min, F.max)]
        boxes = bottom.groupBy(F.shiftright("_cy", bits).alias("_cy"), F.shiftright("_cx", bits).alias("_cx")).agg(*merged)
        boxes = boxes.withColumns({"_py": F.shiftright("_cy", 3), "_px": F.shiftright("_cx", 3)})
        if bits >= 9:
            boxes = F.broadcast(boxes)  # at most 64 ** 2 boxes on the two upper levels
        below, above = F.lit(0.0), F.lit(0.0)
        for a in axes:
            low, high = F.col(f"{a}_min") - F.col(a), F.col(a) - F.col(f"{a}_max")
            least, most = F.greatest(F.lit(0.0), low, high), F.greatest(F.abs(low), F.abs(high))
            below, above = below + least * least, above + most * most
        met = kept.join(boxes, ["_py", "_px"]).withColumns({"_least": F.sqrt(below), "_most": F.sqrt(above)})
        met = met.withColumn("_bound", F.min("_most").over(Window.partitionBy(*by)))
        kept = met.filter(F.col("_least") <= F.col("_bound") + CHORD_SLACK).select(*own, F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
    others = [c for c in places.columns if c not in ("lat", "lon")]
    ends = stored.select(*others, F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
    found = kept.join(ends, ["_py", "_px"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_r"), F.col("lon_r")))
    result = [*points.columns, *others, "lat_r", "lon_r", "km"]
    best = F.min_by(F.struct(*result), F.struct("km", "lat_r", "lon_r")).alias("_best")
    return found.groupBy(*[F.col(b).alias(f"_by_{b}") for b in by]).agg(best).select("_best.*")
