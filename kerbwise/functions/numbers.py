"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORD_SCALE = 10_000_000
# Coordinates are summed as integer offsets from this point, so that a group of
# any size stays within 64 bits and the mean does not depend on addition order.
LAT_ORIGIN_E7 = 129_500_000
LON_ORIGIN_E7 = 776_000_000


def round_half_even(value: Column, digits: int = 0) -> Column:
    """``rint(x * 10^d) / 10^d``, ties to even."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def tenths(value: Column) -> Column:
    """A value with one decimal as an integer count of tenths."""
    return F.rint(value * F.lit(10.0)).cast("long")


def sum_tenths(value: Column) -> Column:
    """Exact sum of one-decimal values, independent of addition order."""
    return F.sum(tenths(value)).cast("double") / F.lit(10.0)


def offset_e7(value: Column, origin: int) -> Column:
    return F.rint(value * F.lit(float(COORD_SCALE))).cast("long") - F.lit(origin)


def mean_from_offsets(offset_sum: Column, count: Column, origin: int) -> Column:
    total = offset_sum.cast("double") + F.lit(float(origin)) * count.cast("double")
    return total / count / F.lit(float(COORD_SCALE))


def mean_lat(value: Column, count: Column | None = None) -> Column:
    n = F.count(value) if count is None else count
    return mean_from_offsets(F.sum(offset_e7(value, LAT_ORIGIN_E7)), n, LAT_ORIGIN_E7)


def mean_lon(value: Column, count: Column | None = None) -> Column:
    n = F.count(value) if count is None else count
    return mean_from_offsets(F.sum(offset_e7(value, LON_ORIGIN_E7)), n, LON_ORIGIN_E7)
