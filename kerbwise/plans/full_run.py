"""The whole analysis of one log: stage tables, report tables and the feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.text import urgency_label, urgency_tier
from kerbwise.operators import anomaly, barricade, bursts, cover, evaluate, models, planned, surface
from kerbwise.operators.impact import enrich
from kerbwise.operators.network import Network, top_edges
from kerbwise.session import cut, prepare, together
from kerbwise.sources import sinks

ENRICHED_COLUMNS = [
    "id", "lat", "lon", "endlatitude", "endlongitude", "t_event", "date", "dow", "is_weekend", "month", "daypart",
    "dur_raw_min", "dur_trust_min", "dur_trust_us", "clearance_censored", "event_type", "cause", "priority", "closure",
    "corridor", "is_corridor", "junction", "zone", "description", "text_signal", "tier", "severity",
    "exp_clearance_min", "corridor_crit", "impact_min",
]


def stage_tables(enriched: DataFrame) -> dict[str, DataFrame]:
    """The tables later steps and other users read. With models, ``run`` writes the
    model's surface as ``risk_by_dow`` instead of the plain averages here."""
    return {
        "incidents_enriched": enriched.select(*ENRICHED_COLUMNS),
        "risk_cells": surface.risk_cells(enriched),
        "risk_cells_by_dow": surface.cell_dow_load(enriched),
        "planned_archetypes": planned.planned_archetypes(enriched),
        "risk_by_dow": surface.weekday_risk(enriched),
    }


def report_sections(enriched: DataFrame, forecast: Callable[[], DataFrame] | None = None) -> dict[str, sinks.Section]:
    """Every section of the feed. ``forecast`` returns the model's
    forecast; without it heat, plan, reach and learning curve come from plain averages.

    Sections and what they share are computed and stored at the same time wherever one does not need the other, those with
    the longest rows of jobs first: many are short and leave room for the joins and counts of the others. The feed is then
    one pass over small stored tables.
    """
    spark = enriched.sparkSession

    def surfaces() -> dict[str, DataFrame]:
        predicted = forecast() if forecast else None
        risk = cut(models.risk_surface_model(predicted) if forecast else surface.weekday_risk(enriched))
        plan = cut(cover.deploy_by_dow(risk))
        reached = evaluate.reach(enriched, plan)
        found = together(
            spark, counterfactual=lambda: cut(evaluate.counterfactual(reached)), equity=lambda: cut(evaluate.equity_by_zone(reached)),
            **({"metrics": lambda: cut(models.risk_metrics(predicted))} if forecast else {}),
        )
        return found | {"risk": risk, "plan": plan}

    def weekly() -> DataFrame:
        days = surface.cell_days(enriched)
        if forecast:
            return cut(models.walk_forward_model(days))
        return cut(evaluate.walk_forward(evaluate.walk_forward_scores(days)))

    def clearance() -> DataFrame:
        if forecast:
            return cut(models.clearance_table(enriched))
        return cut(models.clearance_by_cause(enriched).select("cause", "p50_min", "p90_min"))

    def clearance_errors() -> DataFrame | None:
        return cut(models.clearance_metrics(enriched)) if forecast else None

    def covered() -> dict[str, DataFrame]:
        cells = cut(surface.risk_cells(enriched))
        return together(
            spark, curve=lambda: cut(cover.coverage_curve(cells)),
            busiest=lambda: cut(cover.preposition_busiest(cells, surface.cell_dow_load(enriched))),
        )

    def linked() -> dict[str, DataFrame]:
        network = Network(enriched)
        diversion = cut(network.diversion)
        return together(
            spark, nodes=lambda: network.nodes, edges=lambda: cut(network.edges), blast=lambda: cut(network.blast),
            cascade=lambda: cut(network.cascade), diversion=lambda: diversion,
            barricades=lambda: cut(barricade.barricade_plan(barricade.barricade_zones(enriched), diversion)),
        )

    def flagged() -> DataFrame:
        days = cut(anomaly.abnormal_days(enriched))
        return cut(anomaly.abnormal_context(enriched, days))

    causes = enriched.groupBy("cause").agg(F.count(F.lit(1)).alias("incidents"))
    shared = together(
        spark, surfaces=surfaces, weekly=weekly, linked=linked, clearance=clearance,
        gatherings=lambda: cut(bursts.burst_dedup(bursts.burst_score(enriched))), covered=covered, flagged=flagged,
        confidence=lambda: cut(evaluate.confidence_audit(evaluate.cell_confidence(enriched))),
        meta=lambda: cut(evaluate.summary_meta(enriched)), hotspots=lambda: cut(surface.hotspots(enriched)),
        planned=lambda: cut(planned.planned_p90(enriched)), scenarios=lambda: cut(planned.scenario_archetypes(enriched)),
        dow_load=lambda: cut(anomaly.dow_load(enriched)), corridor_load=lambda: cut(anomaly.corridor_load(enriched)),
        causes=lambda: cut(causes), clearance_errors=clearance_errors,
    )
    surfaced, network, curve = shared["surfaces"], shared["linked"], shared["covered"]["curve"]
    risk, plan, learning = surfaced["risk"], surfaced["plan"], shared["weekly"]
    rec = sinks.records
    sections = {
        "meta": rec(shared["meta"], ["incidents"]),
        "heat": rec(surface.heat(risk), ["gy", "gx"], ["lat", "lon", "exp_impact"]),
        "hotspots": rec(shared["hotspots"].withColumn("o", -F.col("per_day")), ["o", "gy", "gx"],
                        ["lat", "lon", "n", "per_day", "cause", "corridor"]),
        "deploy_by_dow": sinks.grouped(plan, "dow", ["k"], ["lat", "lon", "covers", "cum_coverage_pct"]),
        "clearance_by_cause": rec(shared["clearance"].withColumn("o", -F.col("p90_min")), ["o", "cause"],
                                  ["cause", "p50_min", "p90_min"]),
        "planned_archetypes": rec(shared["planned"], ["archetype"]),
        "dow_load": sinks.mapping(shared["dow_load"], "dow", F.col("impact")),
        "corridor_load": sinks.mapping(shared["corridor_load"], "corridor", F.col("impact")),
        "nodes": rec(network["nodes"], ["corridor"]),
        "top_edges": rec(top_edges(network["edges"]).withColumn("o", -F.col("lift")), ["o", "src", "dst"],
                         ["src", "dst", "count", "lift"]),
        "blast": sinks.grouped(network["blast"], "src", ["rank"], ["dst", "lift"]),
        "diversion": sinks.grouped(network["diversion"], "src", ["rank"], ["dst", "km"]),
        "coverage_curve": rec(curve, ["k"], ["k", "lat", "lon", "cum_coverage_pct"]),
        "units_for": rec(cover.marginal_units(curve), ["u_for_50"]),
        "abnormal_days": rec(shared["flagged"].withColumn("o", -F.col("z")), ["o", "date"],
                             ["date", "z", "impact", "cause", "event"]),
        "barricading": rec(network["barricades"], ["gy", "gx"]),
        "learning_curve": rec(learning, ["week"]),
        "gatherings": rec(shared["gatherings"].withColumn("o", -F.col("size")), ["o", "started"],
                          ["started", "lat", "lon", "size", "area", "cause", "mix", "text"]),
        "scenario_archetypes": rec(shared["scenarios"].withColumn("o", -F.col("bump")), ["o", "name"],
                                   ["name", "lat", "lon", "bump", "events", "p90_hold"]),
        "scenario_cells": rec(surface.dow_vector(risk), ["gy", "gx"], ["lat", "lon", "w"]),
        "cascade": rec(network["cascade"], ["corridor"]),
        "counterfactual": rec(surfaced["counterfactual"], ["reach_pct"]),
        "equity": rec(surfaced["equity"], ["reached_pct", "zone"]),
        "confidence_audit": rec(shared["confidence"], ["confidence", "gy", "gx"]),
    }
    sections["preposition"] = rec(shared["covered"]["busiest"], ["k"], ["dow", "k", "lat", "lon", "anchor_corridor", "covers", "cum_coverage_pct"])
    urgency = shared["causes"].withColumn("tier", urgency_tier(F.col("cause")))
    sections["urgency"] = rec(urgency.withColumn("response", urgency_label(F.col("tier"))), ["cause"], ["cause", "incidents", "tier", "response"])
    if forecast:
        sections["risk_metrics"] = rec(surfaced["metrics"], ["n_cells"])
        sections["clearance_metrics"] = rec(shared["clearance_errors"], ["p50_mae"])
    return sections


def write_incidents(raw: DataFrame, folder: str) -> DataFrame:
    """The scored log, written once by date. What follows reads it with column and partition pruning."""
    return sinks.write_table(enrich(raw).select(*ENRICHED_COLUMNS), f"{folder}/incidents_enriched", "date")


def write_stage_tables(stored: DataFrame, folder: str, risk: DataFrame | None = None) -> dict[str, DataFrame]:
    """The stage tables that follow from the written ``incidents_enriched``; ``risk`` in place of plain averages."""
    rest = {name: df for name, df in stage_tables(stored).items() if name != "incidents_enriched"}
    if risk is not None:
        rest["risk_by_dow"] = risk
    return sinks.write_tables(rest, folder, {})


def run(spark: SparkSession, raw: DataFrame, folder: str, with_models: bool = True) -> DataFrame:
    """Raw log to stage tables and feed under ``folder``; returns the rows of the feed.

    The enriched table is written once, partitioned by date, and everything after it
    reads that table with column and partition pruning.
    """
    prepare(spark)
    stored = write_incidents(raw, folder)
    predicted = []

    def forecast() -> DataFrame:
        predicted.append(cut(models.risk_forecast(surface.cell_days(stored))))
        return predicted[0]

    def document() -> DataFrame:
        feed = sinks.document(spark, sections)
        sinks.write_feed(feed, f"{folder}/feed")
        return feed

    sections = report_sections(stored, forecast if with_models else None)
    risk = models.risk_surface_model(predicted[0]) if with_models else None
    written = together(spark, tables=lambda: write_stage_tables(stored, folder, risk), feed=document)
    return sinks.feed_rows(written["feed"])
