"""Work done once, and at the same time: the whole run, its tables and the network read the log no more often than needed."""

import threading

from pyspark.sql import functions as F

from kerbwise.operators import evaluate, models, surface
from kerbwise.plans import full_run
from kerbwise.plans.registry import QUERIES
from kerbwise.session import together
from kerbwise.sources import sinks
from kerbwise.sources.event_log import scan_events


def test_forecast_and_weekly_fits_run_at_the_same_time(spark, sf_dir, tmp_path, monkeypatch):
    meet = threading.Barrier(2)

    def forecast(days):
        meet.wait(100)
        return surface.cell_date_panel(days).withColumn("pred", F.lit(1.0))

    def weekly(days):
        meet.wait(100)
        return evaluate.walk_forward(evaluate.walk_forward_scores(days))

    monkeypatch.setattr(models, "risk_forecast", forecast)
    monkeypatch.setattr(models, "walk_forward_model", weekly)
    monkeypatch.setattr(models, "clearance_table", lambda e: models.clearance_by_cause(e).drop("n"))
    monkeypatch.setattr(models, "clearance_metrics", lambda e: spark.range(1).select(F.lit(1.0).alias("p50_mae")))
    listed = {r["section"] for r in full_run.run(spark, scan_events(spark, sf_dir), str(tmp_path)).select("section").collect()}
    assert {"heat", "learning_curve", "risk_metrics", "clearance_metrics", "preposition"} <= listed
    written = spark.read.parquet(f"{tmp_path}/risk_by_dow")
    assert [r[0] for r in written.select("exp_impact").distinct().collect()] == [1.0]


def test_pieces_of_work_by_name(spark):
    got = together(spark, a=lambda: spark.range(3).count(), b=lambda: spark.range(5).count())
    assert got == {"a": 3, "b": 5}


def test_stage_tables_follow_from_the_written_log(spark, sf_dir, monkeypatch):
    sources = {}
    write = sinks.write_table

    def noted(df, path, *args, **kwargs):
        sources[path.rsplit("/", 1)[1]] = " ".join(df.inputFiles())
        return write(df, path, *args, **kwargs)

    monkeypatch.setattr(sinks, "write_table", noted)
    rows = {r["table"]: r["rows"] for r in QUERIES["write_tables"](spark, sf_dir).collect()}
    assert "events.parquet" in sources.pop("incidents_enriched") and len(sources) == 4
    assert not any("events.parquet" in files for files in sources.values())
    assert "incidents_enriched" in sources["risk_cells"] and rows["incidents_enriched"] > rows["risk_cells"] > 0
