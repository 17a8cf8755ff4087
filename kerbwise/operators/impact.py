"""Scoring of incidents in congestion-minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.numbers import round_half_even
from kerbwise.functions.quantiles import exact_quantile
from kerbwise.functions.text import text_signal
from kerbwise.operators.cleaning import US_PER_MIN, clean
from kerbwise.session import cut, sized

LEVEL_KEYS = (("cause", "priority", "tier"), ("cause", "priority"), ("cause",), ())


def corridor_tier(is_corridor: Column) -> Column:
    return F.when(is_corridor == 1, "art").otherwise("loc")


def severity(df: DataFrame) -> DataFrame:
    """Priority, closure and text factors, multiplied in this order."""
    by_text = F.when(F.col("text_signal") == 1, 1.25).when(F.col("text_signal") == -1, 0.6).otherwise(1.0)
    return df.withColumn(
        "severity",
        F.when(F.col("priority") == "High", 2.0).otherwise(1.0)
        * F.when(F.col("closure") == 1, 1.8).otherwise(1.0)
        * by_text,
    )


def lookup_counts(cleaned: DataFrame) -> DataFrame:
    """Incident counts from which both lookup tables follow, so the log is read once.

    Counting per distinct value happens before the shuffle; a corridor or cause
    that holds most of the log is reduced to its distinct durations.
    """
    hot = (F.col("priority") == "High") | (F.col("closure") == 1)
    return (
        cleaned.withColumn("tier", corridor_tier(F.col("is_corridor")))
        .groupBy("corridor", *LEVEL_KEYS[0], hot.alias("hot"), "dur_trust_us")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clearance_medians(counts: DataFrame) -> DataFrame:
    """Median trusted minutes at all four fallback levels, from ``lookup_counts``.

    Rows are ``(level, cause, priority, tier, med_min, n)``; level 3 has all three
    keys, level 0 is the whole log. The levels are rolled up from value counts.
    """
    key = {name: F.col(name) for name in LEVEL_KEYS[0]}
    levels = F.array(
        *[
            F.struct(
                F.lit(len(keys)).alias("level"),
                *[(key[k] if k in keys else F.lit(None).cast("string")).alias(k) for k in LEVEL_KEYS[0]],
            )
            for keys in LEVEL_KEYS
        ]
    )
    rolled = (
        counts.filter(F.col("dur_trust_us").isNotNull())
        .groupBy(*LEVEL_KEYS[0], "dur_trust_us")
        .agg(F.sum("n").alias("n"))
        .select(F.explode(levels).alias("k"), "dur_trust_us", "n")
        .select("k.*", "dur_trust_us", "n")
        .groupBy("level", *LEVEL_KEYS[0], "dur_trust_us")
        .agg(F.sum("n").alias("freq"))
    )
    medians = exact_quantile(
        rolled, ["level", *LEVEL_KEYS[0]], "dur_trust_us", 0.5, "med_us", coarse_width=US_PER_MIN
    )
    return medians.select(
        "level",
        *LEVEL_KEYS[0],
        (F.col("med_us") / F.lit(float(US_PER_MIN))).alias("med_min"),
        F.col("med_us_n").alias("n"),
    )


def corridor_criticality(counts: DataFrame) -> DataFrame:
    """Share of high-priority or closure incidents per corridor, scaled to 1..2."""
    share = counts.groupBy("corridor").agg(
        (F.sum(F.when(F.col("hot"), F.col("n")).otherwise(0)).cast("double") / F.sum("n").cast("double")).alias(
            "share"
        )
    )
    extremes = share.agg(F.struct(F.min("share").alias("low"), F.max("share").alias("high")).alias("e")).scalar()
    low, high = extremes["low"], extremes["high"]
    return share.select(
        "corridor", (F.lit(1.0) + (F.col("share") - low) / (high - low + F.lit(1e-9))).alias("corridor_crit")
    )


def hierarchical_lookup(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Expected clearance: the most specific level with a median, clipped to 2..600.

    ``medians`` keeps its broadcast mark when it has been size-checked.
    """
    df = df.withColumn("tier", corridor_tier(F.col("is_corridor")))
    candidates = []
    for keys in LEVEL_KEYS[:-1]:
        name = f"_m{len(keys)}"
        table = medians.filter(F.col("level") == len(keys)).select(*keys, F.col("med_min").alias(name))
        df = df.join(table, list(keys), "left")
        candidates.append(F.col(name))
    overall = medians.filter(F.col("level") == 0).agg(F.max("med_min").alias("m")).scalar()
    low, high = S.CLEARANCE_CLIP_MIN
    expected = F.coalesce(*candidates, overall)
    clipped = F.when(expected.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), expected)))
    return df.withColumn("exp_clearance_min", clipped).drop("_m1", "_m2", "_m3")


def dim_map(df: DataFrame, criticality: DataFrame) -> DataFrame:
    """Corridor criticality by name, 1.0 where the corridor is unknown."""
    return df.join(criticality, "corridor", "left").withColumn(
        "corridor_crit", F.coalesce("corridor_crit", F.lit(1.0))
    )


def score(cleaned: DataFrame, medians: DataFrame, criticality: DataFrame) -> DataFrame:
    """Severity x criticality x expected clearance, to one decimal."""
    df = cleaned.withColumn("text_signal", text_signal(F.col("description")))
    df = dim_map(hierarchical_lookup(severity(df), medians), criticality)
    impact = F.col("severity") * F.col("corridor_crit") * F.col("exp_clearance_min")
    return df.withColumn("impact_min", round_half_even(impact, 1))


def lookups(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lookup tables, computed once and size-checked for broadcast."""
    return lookups_from(cut(lookup_counts(cleaned)))


def lookups_from(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lookup tables from stored ``lookup_counts``."""
    return sized(clearance_medians(counts)), sized(corridor_criticality(counts))


def enrich(raw: DataFrame, bounds: S.Bounds = S.BOUNDS, tz: str = S.TIMEZONE) -> DataFrame:
    """Raw log to scored incidents."""
    cleaned = clean(raw, bounds, tz)
    return score(cleaned, *lookups(cleaned))
