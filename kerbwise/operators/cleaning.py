"""Typing and cleaning of the raw log: coordinates, times, durations, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.text import strip
from kerbwise.session import prepare
from kerbwise.sources.incidents import null_tokens

TIME_COLUMNS = {
    "t_start": "start_datetime",
    "t_created": "created_date",
    "t_modified": "modified_datetime",
    "t_closed": "closed_datetime",
    "t_resolved": "resolved_datetime",
}
US_PER_MIN = 60_000_000


def geo_clean(df: DataFrame, bounds: S.Bounds = S.BOUNDS) -> DataFrame:
    """Numeric coordinates; rows without a position inside the box are dropped."""
    return df.withColumns(
        {
            "lat": F.expr("try_cast(latitude AS double)"),
            "lon": F.expr("try_cast(longitude AS double)"),
        }
    ).filter(
        F.col("lat").between(bounds.lat_min, bounds.lat_max)
        & F.col("lon").between(bounds.lon_min, bounds.lon_max)
    )


def event_time(df: DataFrame) -> DataFrame:
    """Parse the five timestamps as UTC; the event time is created, else start."""
    prepare(df.sparkSession)
    parsed = df.withColumns({new: F.try_to_timestamp(F.col(old)) for new, old in TIME_COLUMNS.items()})
    return parsed.withColumn("t_event", F.coalesce("t_created", "t_start"))


def time_features(df: DataFrame, tz: str = S.TIMEZONE) -> DataFrame:
    """Local weekday (Monday 0), weekend flag, month, date and part of the day."""
    prepare(df.sparkSession)  # from_utc_timestamp shifts what the session's zone renders
    local = F.from_utc_timestamp(F.col("t_event"), tz)
    hour = F.hour(local)
    return df.withColumns(
        {
            "dow": F.weekday(local),
            "is_weekend": F.coalesce(F.weekday(local).isin(5, 6), F.lit(False)).cast("int"),
            "month": F.month(local),
            "date": F.to_date(local),
            "daypart": F.when(hour.isNull(), "unknown")
            .when(hour <= 6, "night")
            .when(hour <= 11, "morning")
            .when(hour <= 16, "midday")
            .when(hour <= 21, "evening")
            .otherwise("late"),
        }
    )


def clearance_censoring(df: DataFrame) -> DataFrame:
    """Raw duration, the batch-close flag and the duration that can be trusted."""
    end = F.coalesce("t_closed", "t_resolved", "t_modified")
    low, high = S.CENSOR_BAND_MIN
    micros = F.unix_micros(end) - F.unix_micros(F.col("t_event"))
    df = df.withColumn("dur_us", micros)
    censored = (
        F.col("dur_us").between(low * US_PER_MIN, high * US_PER_MIN)
        & F.col("t_resolved").isNull()
        & F.col("t_closed").isNotNull()
    )
    df = df.withColumn("clearance_censored", F.coalesce(censored, F.lit(False)).cast("int"))
    trusted = (
        (F.col("dur_us") > 0)
        & (F.col("dur_us") < S.TRUST_LIMIT_MIN * US_PER_MIN)
        & (F.col("clearance_censored") == 0)
    )
    df = df.withColumn("dur_trust_us", F.when(trusted, F.col("dur_us")))
    return df.withColumns(
        {
            "dur_raw_min": F.col("dur_us") / F.lit(float(US_PER_MIN)),
            "dur_trust_min": F.col("dur_trust_us") / F.lit(float(US_PER_MIN)),
        }
    ).drop("dur_us")


def normalise_categories(df: DataFrame) -> DataFrame:
    corridor = strip(F.coalesce("corridor", F.lit(S.NON_CORRIDOR)))
    return df.withColumns(
        {
            "event_type": strip(F.lower("event_type")),
            "cause": F.coalesce(strip(F.lower("event_cause")), F.lit("others")),
            "priority": F.coalesce("priority", F.lit("Low")),
            "closure": F.coalesce(F.upper("requires_road_closure") == "TRUE", F.lit(False)).cast("int"),
            "corridor": corridor,
            "is_corridor": (corridor != S.NON_CORRIDOR).cast("int"),
        }
    )


def clean(raw: DataFrame, bounds: S.Bounds = S.BOUNDS, tz: str = S.TIMEZONE) -> DataFrame:
    """All cleaning steps in order."""
    df = geo_clean(null_tokens(raw), bounds)
    return normalise_categories(clearance_censoring(time_features(event_time(df), tz)))
