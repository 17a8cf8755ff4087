"""Named queries over the test tables: every operator as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.geo import grid_index, haversine_km
from kerbwise.functions.numbers import round_half_even
from kerbwise.functions.text import archetype, text_signal, urgency_label, urgency_tier
from kerbwise.operators import anomaly, barricade, bursts, cleaning, cover, evaluate, impact, models, network, planned, surface, survival
from kerbwise.plans import full_run
from kerbwise.session import cut, shared_dir
from kerbwise.sources import sinks
from kerbwise.sources.event_log import scan_events
from kerbwise.sources.incidents import null_tokens
from kerbwise.streaming import live, refit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# A given point for the what-if sweep: name, latitude, longitude, extra impact.
# A given date for the calendar lookup: month, day, weekday (Monday 0).
DATE = (1, 15, 0)
PIN = ("Custom event", 12.97, 77.62, 600.0)


def _raw(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(scan_events(spark, sf_dir))
    return fn


def _cleaned(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(cleaning.clean(scan_events(spark, sf_dir)))
    return fn


def _enriched(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(impact.enrich(scan_events(spark, sf_dir)))
    return fn


def _direct(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _seconds(column: str):
    return F.unix_seconds(column).alias(column)


# Scans and cleaning ---------------------------------------------------------


@_raw
def scan_incidents(raw):
    return raw


@_raw
def clean_null_tokens(raw):
    return null_tokens(raw)


QUERIES["null_tokens"] = QUERIES.pop("clean_null_tokens")


@_raw
def geo_clean(raw):
    return cleaning.geo_clean(null_tokens(raw)).select("id", "lat", "lon")


@_raw
def event_time(raw):
    times = cleaning.event_time(cleaning.geo_clean(null_tokens(raw)))
    return times.select("id", *[_seconds(c) for c in (*cleaning.TIME_COLUMNS, "t_event")])


@_cleaned
def time_features(cleaned):
    return cleaned.select("id", "dow", "is_weekend", "month", "date")


@_cleaned
def daypart(cleaned):
    return cleaned.select("id", "daypart")


@_cleaned
def clearance_censoring(cleaned):
    return cleaned.select("id", "dur_raw_min", "clearance_censored", "dur_trust_min")


@_cleaned
def normalise_categories(cleaned):
    return cleaned.select("id", "event_type", "cause", "priority", "closure", "corridor", "is_corridor")


QUERIES["text_signal"] = lambda spark, sf_dir: cleaning.clean(scan_events(spark, sf_dir)).select(
    "id", text_signal(F.col("description")).alias("text_signal")
)
QUERIES["severity"] = lambda spark, sf_dir: impact.severity(
    cleaning.clean(scan_events(spark, sf_dir)).withColumn("text_signal", text_signal(F.col("description")))
).select("id", "severity")
QUERIES["archetype"] = lambda spark, sf_dir: surface.planned(cleaning.clean(scan_events(spark, sf_dir))).select(
    "id",
    archetype(F.col("description")).alias("report_label"),
    archetype(F.col("description"), S.CALENDAR_RULES).alias("calendar_label"),
    archetype(F.col("description"), S.SCENARIO_RULES, S.DEFAULT_SCENARIO).alias("scenario_label"),
)


def _urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean(scan_events(spark, sf_dir))
    label = F.when(
        F.col("event_type") == "planned", archetype(F.col("description"), S.CALENDAR_RULES)
    ).otherwise("")
    tier = urgency_tier(F.col("cause"), label)
    return cleaned.select("id", "cause", tier.alias("tier"), urgency_label(tier).alias("response"))


QUERIES["urgency_tier"] = _urgency


@_cleaned
def grid_cell(cleaned):
    return cleaned.select(
        "id", grid_index(F.col("lat")).alias("gy"), grid_index(F.col("lon")).alias("gx"),
        grid_index(F.col("lat"), S.ZONE_GRID_DEG).alias("zone_gy"), grid_index(F.col("lon"), S.ZONE_GRID_DEG).alias("zone_gx"),
    )


QUERIES["haversine_km"] = lambda spark, sf_dir: cleaning.clean(scan_events(spark, sf_dir)).select(
    "id",
    round_half_even(
        haversine_km(
            F.col("lat"), F.col("lon"), F.expr("try_cast(endlatitude AS double)"), F.expr("try_cast(endlongitude AS double)")
        ),
        6,
    ).alias("km"),
)


@_enriched
def approach_points(enriched):
    return barricade.approach_points(enriched)


# Scoring --------------------------------------------------------------------


def _clearance_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(impact.lookup_counts(cleaning.clean(scan_events(spark, sf_dir))))
    return impact.clearance_medians(counts).withColumn("med_min", round_half_even(F.col("med_min"), 4))


def _corridor_criticality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(impact.lookup_counts(cleaning.clean(scan_events(spark, sf_dir))))
    return impact.corridor_criticality(counts).withColumn("corridor_crit", round_half_even(F.col("corridor_crit"), 8))


QUERIES["clearance_medians"] = _clearance_medians
QUERIES["corridor_criticality"] = _corridor_criticality


@_enriched
def hierarchical_lookup(enriched):
    return enriched.select("id", round_half_even(F.col("exp_clearance_min"), 6).alias("exp_clearance_min"))


@_enriched
def dim_map(enriched):
    return enriched.select("id", "corridor", round_half_even(F.col("corridor_crit"), 8).alias("corridor_crit"))


@_enriched
def impact_min(enriched):
    return enriched.select("id", "impact_min")


# Grid -----------------------------------------------------------------------


def _cell_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": round_half_even(F.col("lat"), 6), "lon": round_half_even(F.col("lon"), 6)})


@_enriched
def cell_dow_load(enriched):
    return surface.cell_dow_load(enriched)


@_enriched
def risk_cells(enriched):
    return _cell_columns(surface.risk_cells(enriched))


@_enriched
def hotspots(enriched):
    return surface.hotspots(enriched)


@_enriched
def heat(enriched):
    return surface.heat(surface.weekday_risk(enriched))


@_enriched
def dow_vector(enriched):
    vector = surface.dow_vector(surface.weekday_risk(enriched))
    return vector.select("gy", "gx", "lat", "lon", *[F.col("w")[d].alias(f"w{d}") for d in range(7)])


@_enriched
def cell_date_panel(enriched):
    panel = surface.cell_date_panel(surface.cell_days(enriched))
    return _cell_columns(panel).withColumns(
        {"crit": round_half_even(F.col("crit"), 6), "hist_rate": round_half_even(F.col("hist_rate"), 6)}
    )


@_enriched
def cell_date_panel_leaky(enriched):
    panel = surface.cell_date_panel(surface.cell_days(enriched), leaky=True)
    return _cell_columns(panel).withColumns(
        {"crit": round_half_even(F.col("crit"), 6), "hist_rate": round_half_even(F.col("hist_rate"), 6)}
    )


# Planned events -------------------------------------------------------------


@_enriched
def planned_archetypes(enriched):
    return planned.planned_archetypes(enriched)


@_enriched
def planned_p90(enriched):
    return planned.planned_p90(enriched)


@_enriched
def scenario_archetypes(enriched):
    return planned.scenario_archetypes(enriched)


@_enriched
def calendar_uplift(enriched):
    plan = cover.deploy_by_dow(surface.weekday_risk(enriched))
    return planned.calendar_uplift(enriched, cover.plan_coverage(plan))


# Network --------------------------------------------------------------------


@_enriched
def corridor_nodes(enriched):
    return _cell_columns(network.corridor_nodes(enriched))


@_enriched
def spillover_pairs(enriched):
    return network.Network(enriched).pairs


@_enriched
def spillover_edges(enriched):
    return network.Network(enriched).edges


@_enriched
def top_edges(enriched):
    return network.top_edges(network.Network(enriched).edges)


@_enriched
def blast_radius(enriched):
    return network.Network(enriched).blast


@_enriched
def diversion(enriched):
    return network.Network(enriched).diversion


QUERIES["nearest_k"] = QUERIES["diversion"]


@_enriched
def cascade_totals(enriched):
    return network.Network(enriched).cascade


# Bursts and barricades ------------------------------------------------------


@_cleaned
def burst_neighbours(cleaned):
    return bursts.burst_neighbours(cleaned)


@_cleaned
def burst_score(cleaned):
    return bursts.burst_score(cleaned).select("id", "size", "mix", "dom_cause", "dom_share")


@_cleaned
def burst_dedup(cleaned):
    return bursts.burst_dedup(bursts.burst_score(cleaned))


@_enriched
def barricade_zones(enriched):
    return _cell_columns(barricade.barricade_zones(enriched)).withColumn(
        "impact", round_half_even(F.col("impact"), 1)
    )


@_enriched
def barricade_plan(enriched):
    return barricade.barricade_plan(barricade.barricade_zones(enriched), network.Network(enriched).diversion)


# Loads and abnormal days ----------------------------------------------------


@_enriched
def daily_load(enriched):
    return anomaly.daily_load(enriched)


@_enriched
def dow_load(enriched):
    return anomaly.dow_load(enriched)


@_enriched
def corridor_load(enriched):
    return anomaly.corridor_load(enriched)


@_enriched
def abnormal_days(enriched):
    return anomaly.abnormal_days(enriched)


@_enriched
def abnormal_context(enriched):
    return anomaly.abnormal_context(enriched, cut(anomaly.abnormal_days(enriched)))


@_enriched
def summary_meta(enriched):
    return evaluate.summary_meta(enriched)


# Coverage -------------------------------------------------------------------


@_enriched
def cells_in_reach(enriched):
    cells = cut(surface.risk_cells(enriched))
    return cover.cells_in_reach(cells, S.REACH_KM).withColumn("km", round_half_even(F.col("km"), 6))


@_enriched
def preposition(enriched):
    return _cell_columns(cover.preposition(surface.risk_cells(enriched)))


@_enriched
def preposition_busiest(enriched):
    return _cell_columns(cover.preposition_busiest(surface.risk_cells(enriched), surface.cell_dow_load(enriched)))


@_enriched
def plan_for_date(enriched):
    return planned.plan_for_date(enriched, cut(cover.deploy_by_dow(surface.weekday_risk(enriched))), *DATE)


@_enriched
def deploy_by_dow(enriched):
    return cover.deploy_by_dow(surface.weekday_risk(enriched))


@_enriched
def coverage_curve(enriched):
    return cover.coverage_curve(surface.risk_cells(enriched))


@_enriched
def marginal_units(enriched):
    return cover.marginal_units(cover.coverage_curve(surface.risk_cells(enriched)))


@_enriched
def event_bump(enriched):
    cells = cut(surface.risk_cells(enriched))
    return cover.event_bump(cells, cover.event_points(cut(planned.scenario_archetypes(enriched)), [PIN]))


@_enriched
def scenario_sweep(enriched):
    events = cover.event_points(planned.scenario_archetypes(enriched), [PIN])
    return cover.scenario_sweep(surface.weekday_risk(enriched), events)


# Evaluation -----------------------------------------------------------------


def _reached(enriched: DataFrame) -> DataFrame:
    return evaluate.reach(enriched, cut(cover.deploy_by_dow(surface.weekday_risk(enriched))))


@_enriched
def reach(enriched):
    return _reached(enriched).select("id", F.col("reached").cast("int").alias("reached"))


@_enriched
def counterfactual(enriched):
    return evaluate.counterfactual(_reached(enriched))


@_enriched
def equity_by_zone(enriched):
    return evaluate.equity_by_zone(_reached(enriched))


@_enriched
def confidence_audit(enriched):
    return evaluate.confidence_audit(evaluate.cell_confidence(enriched))


@_enriched
def capture_at_top(enriched):
    return evaluate.capture_at_top(surface.cell_days(enriched))


@_enriched
def cell_mean_baseline(enriched):
    scored = evaluate.cell_mean_baseline(surface.cell_date_panel(surface.cell_days(enriched)))
    return evaluate.mean_capture(evaluate.capture_by_date(scored))


@_enriched
def walk_forward(enriched):
    return evaluate.walk_forward(evaluate.walk_forward_scores(surface.cell_days(enriched)))


# Models ---------------------------------------------------------------------


@_enriched
def risk_forecast(enriched):
    return models.risk_forecast(surface.cell_days(enriched)).select("gy", "gx", "date", "dow", "y", "pred")


@_enriched
def risk_surface_model(enriched):
    return models.risk_surface_model(models.risk_forecast(surface.cell_days(enriched)))


@_enriched
def risk_metrics(enriched):
    return models.risk_metrics(cut(models.risk_forecast(surface.cell_days(enriched))))


@_enriched
def walk_forward_model(enriched):
    return models.walk_forward_model(surface.cell_days(enriched))


@_enriched
def clearance_quantiles(enriched):
    return models.clearance_quantiles(enriched)


@_enriched
def clearance_table(enriched):
    return models.clearance_table(enriched)


@_enriched
def clearance_by_cause(enriched):
    return models.clearance_by_cause(enriched)


@_enriched
def survival_curve(enriched):
    return survival.survival_curve(enriched)


@_enriched
def clearance_survival(enriched):
    return survival.clearance_survival(enriched)


@_enriched
def model_metrics(enriched):
    return models.baseline_metrics(enriched)


@_enriched
def clearance_metrics(enriched):
    return models.clearance_metrics(enriched)


# Sinks and streams ----------------------------------------------------------


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kerbwise-{name}-{uuid.uuid4().hex}"


@_direct
def write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the stage tables and report the rows read back from each."""
    folder = _fresh_folder(spark, "tables")
    stored = full_run.write_incidents(scan_events(spark, sf_dir), folder)
    written = {"incidents_enriched": stored} | full_run.write_stage_tables(stored, folder)
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in written.items()]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


@_direct
def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all stage tables and the nested feed document; returns its report rows."""
    return full_run.run(spark, scan_events(spark, sf_dir), _fresh_folder(spark, "feed"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return live.read_event_stream(spark, sf_dir, schema)


@_direct
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookups = impact.lookups(cleaning.clean(scan_events(spark, sf_dir)))
    stream = live.stream_enrich(_event_stream(spark, sf_dir), *lookups).select(
        "id", "date", "dow", "cause", "text_signal", "impact_min"
    )
    folder = _fresh_folder(spark, "enrich")
    return live.run_available(stream, f"{folder}/rows", f"{folder}/progress")


@_direct
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.windowed_bursts(cleaning.clean(_event_stream(spark, sf_dir)))
    folder = _fresh_folder(spark, "bursts")
    return live.run_available(stream, f"{folder}/rows", f"{folder}/progress")


@_cleaned
def windowed_bursts(cleaned):
    return live.windowed_bursts(cleaned)


@_direct
def circle_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live alarm on the true circle, streamed."""
    stream = live.circle_bursts(cleaning.clean(_event_stream(spark, sf_dir)))
    folder = _fresh_folder(spark, "circles")
    found = live.run_available(stream, f"{folder}/rows", f"{folder}/progress")
    return found.withColumns({c: round_half_even(F.col(c), 5) for c in ("lat", "lon")})


def _refitted(spark: SparkSession, sf_dir: str) -> tuple[refit.LookupStore, DataFrame]:
    folder = _fresh_folder(spark, "refit")
    store = refit.LookupStore(spark, f"{folder}/counts")
    return store, refit.refit_enrich(_event_stream(spark, sf_dir), store, f"{folder}/rows", f"{folder}/progress")


@_direct
def refit_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents scored by the stream while it keeps the lookups up to date."""
    return _refitted(spark, sf_dir)[1].select("id", "impact_min")


@_direct
def refit_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median clearance and criticality as the stream left them."""
    medians, criticality = _refitted(spark, sf_dir)[0].lookups()
    label = F.lit(None).cast("string")
    return medians.select(
        "level", "cause", "priority", "tier", label.alias("corridor"), round_half_even(F.col("med_min"), 4).alias("value")
    ).unionByName(
        criticality.select(
            F.lit(None).cast("int").alias("level"), label.alias("cause"), label.alias("priority"), label.alias("tier"),
            "corridor", round_half_even(F.col("corridor_crit"), 4).alias("value"),
        )
    )
