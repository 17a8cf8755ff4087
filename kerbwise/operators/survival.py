"""Clearance as survival: product-limit curves in which censored incidents count as censored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.numbers import round_half_even
from kerbwise.operators.cleaning import US_PER_MIN
from kerbwise.session import cut

# Running products come from sums of logarithms; a share this close to a level has reached it.
LEVEL_SLACK = 1e-9


def lifetimes(enriched: DataFrame) -> DataFrame:
    """Incidents per cause, minute and outcome: ``cause``, ``minute`` (rounded up), ``cleared``, ``censored``.

    A trusted duration ends in a clearance. A batch-closed one is censored at its raw duration, a
    longer one at the limit of trust, and an incident without an end is still open at the last instant of the log (at
    most the limit). Incidents without a time or with a duration of zero or less are left out.
    Minutes are bounded by the limit, so a cause of any size is at most that many rows.
    """
    limit = S.TRUST_LIMIT_MIN * US_PER_MIN
    latest = enriched.select(F.max(F.unix_micros("t_event")).alias("t")).scalar()
    raw = F.rint(F.col("dur_raw_min") * F.lit(float(US_PER_MIN))).cast("long")
    us = F.least(F.coalesce(F.col("dur_trust_us"), raw, latest - F.unix_micros("t_event")), F.lit(limit).cast("long"))
    minute = F.when(us > 0, F.floor((us + F.lit(US_PER_MIN - 1)) / F.lit(US_PER_MIN))).cast("long")
    seen = F.count("dur_trust_us")
    # Counted, not filtered, by minute: a filter would be pushed below the cleaning steps with the whole expression inlined.
    counts = enriched.groupBy("cause", minute.alias("minute")).agg(
        seen.alias("cleared"), (F.count(F.lit(1)) - seen).alias("censored"), F.count(minute).alias("known")
    )
    return counts.filter(F.col("known") > 0).drop("known")


def survival_curve(enriched: DataFrame) -> DataFrame:
    """Product-limit estimate per cause and minute: ``at_risk``, ``cleared``, ``censored`` and the share still open.

    Censored incidents are at risk up to and including their minute.
    """
    later = Window.partitionBy("cause").orderBy(F.desc("minute"))
    until = Window.partitionBy("cause").orderBy("minute")
    counts = lifetimes(enriched).withColumn("at_risk", F.sum(F.col("cleared") + F.col("censored")).over(later))
    last = F.max(F.when(F.col("cleared") == F.col("at_risk"), 1)).over(until).isNotNull()
    factor = F.when(F.col("cleared") < F.col("at_risk"), F.log((F.col("at_risk") - F.col("cleared")) / F.col("at_risk")))
    share = F.when(last, F.lit(0.0)).otherwise(F.exp(F.sum(factor).over(until)))
    return counts.withColumn("open_share", share).select(
        "cause", "minute", "at_risk", "cleared", "censored", round_half_even(F.col("open_share"), 6).alias("open_share")
    )


def clearance_survival(enriched: DataFrame) -> DataFrame:
    """Per cause: incidents, share censored, and the minutes by which half and nine tenths are cleared.

    A level that the curve never reaches, because too many incidents are censored, has null minutes.
    """
    curve = cut(survival_curve(enriched))

    def reached(level: float) -> Column:
        return F.min(F.when(F.col("open_share") <= F.lit(1.0 - level + LEVEL_SLACK), F.col("minute")))

    n = F.sum(F.col("cleared") + F.col("censored"))
    return curve.groupBy("cause").agg(
        n.alias("n"), F.sum("cleared").alias("cleared"),
        round_half_even(F.sum("censored") / n, 4).alias("censored_share"),
        reached(0.5).alias("p50_min"), reached(0.9).alias("p90_min"), F.min("open_share").alias("open_share"),
    )
