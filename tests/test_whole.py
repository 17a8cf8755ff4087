import datetime as dt
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows
from kerbwise.operators import cleaning, impact, models, surface
from kerbwise.plans import full_run
from kerbwise.plans.oracle import ORACLE
from kerbwise.plans.registry import QUERIES
from kerbwise.sources.event_log import scan_events
from kerbwise.streaming import live
from tests.helpers import by_id, raw


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


SAMPLE = ["risk_cells", "calendar_uplift", "cascade_totals", "barricade_plan", "counterfactual", "walk_forward",
          "burst_neighbours", "marginal_units", "stream_bursts"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    result = database.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_every_sql_names_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_full_run_writes_tables_and_feed(spark, sf_dir, tmp_path):
    listed = full_run.run(spark, scan_events(spark, sf_dir), str(tmp_path / "out"), with_models=False).groupBy("section").count()
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out" / "feed").glob("part-*")))
    feed = json.loads(text)
    assert feed["meta"][0]["incidents"] == 987
    assert len(feed["hotspots"]) == 15 and set(feed["deploy_by_dow"]) == {str(d) for d in range(7)}
    counts = {r["section"]: r["count"] for r in listed.collect()}
    for name, part in feed.items():
        nested = isinstance(part, dict) and all(isinstance(v, list) for v in part.values())
        assert (sum(map(len, part.values())) if nested else len(part)) == counts.get(name, 0)
    lists = {"blast", "deploy_by_dow", "diversion"}
    assert {n for n, part in feed.items() if isinstance(part, dict)} == lists | {"dow_load", "corridor_load"}
    per_day = [h["per_day"] for h in feed["hotspots"]]
    assert per_day == sorted(per_day, reverse=True)
    stored = spark.read.parquet(str(tmp_path / "out" / "incidents_enriched"))
    assert stored.count() == 987 and (tmp_path / "out" / "incidents_enriched" / "date=2024-01-01").exists()


def test_streamed_scores_equal_batch_and_drop_repeats(spark, tmp_path):
    def part(name, items):
        raw(spark, items).write.parquet(str(tmp_path / "in" / name))

    base = [{"id": f"A{i}", "created_date": f"2024-01-01 06:{i:02d}:00+00", "event_cause": c,
             "resolved_datetime": "2024-01-01 08:00:00+00"} for i, c in enumerate(["accident", "debris", "accident"])]
    part("one", base)
    part("two", [base[1], {"id": "B", "created_date": "2024-01-01 06:10:00+00"}])
    everything = raw(spark, base + [{"id": "B", "created_date": "2024-01-01 06:10:00+00"}])
    cleaned = cleaning.clean(everything)
    lookups = impact.lookups(cleaned)
    source = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream = live.stream_enrich(source, *lookups).select("id", "impact_min")
    got = live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert got.count() == 4
    assert by_id(got, "impact_min") == by_id(impact.score(cleaned, *lookups), "impact_min")


def test_streamed_alarm_ignores_rows_behind_the_watermark(spark, tmp_path):
    def rows_at(day, hour, ids):
        return [{"id": i, "created_date": f"2024-01-{day:02d} {hour:02d}:{m:02d}:00+00", "event_cause": "accident"}
                for m, i in enumerate(ids)]

    batches = [rows_at(1, 6, "abcd"), rows_at(3, 6, "e"), rows_at(1, 6, "fgh"), rows_at(5, 6, "i")]
    folder = tmp_path / "in"
    schema = raw(spark, [{}]).schema
    for n, batch in enumerate(batches):
        raw(spark, batch).coalesce(1).write.parquet(str(folder / f"b{n}"))
        stream = live.windowed_bursts(cleaning.clean(spark.readStream.schema(schema).parquet(str(folder / "*"))))
        got = live.run_available(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    sizes = {(r["window_start"], r["size"]) for r in got.collect()}
    assert sizes and all(size == 4 for _, size in sizes)


def test_forest_quantiles_are_ordered_and_follow_the_signal(spark):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        when = start + dt.timedelta(hours=3 * i)
        cause, base = ("accident", 20) if i % 2 else ("construction", 200)
        rows.append({"created_date": when.strftime("%Y-%m-%d %H:%M:%S+00"), "event_cause": cause,
                     "resolved_datetime": (when + dt.timedelta(minutes=base + i * 7 % 30)).strftime("%Y-%m-%d %H:%M:%S+00")})
    enriched = impact.enrich(raw(spark, rows))
    table = {r["cause"]: (r["p50_min"], r["p90_min"]) for r in models.clearance_table(enriched).collect()}
    assert all(p50 <= p90 for p50, p90 in table.values())
    assert table["accident"][1] < 60 < table["construction"][0]
    metrics = models.clearance_metrics(enriched).collect()[0]
    assert metrics["p50_mae"] < metrics["baseline_mae"]


def test_risk_model_learns_place(spark):
    rows = []
    for d in range(80):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        for lat, count in (("12.90", 4), ("13.00", 1 if d % 3 == 0 else 0)):
            rows += [{"latitude": lat, "created_date": f"{day} 06:00:00+00", "resolved_datetime": f"{day} 07:00:00+00"}] * count
    days = surface.cell_days(impact.enrich(raw(spark, rows)))
    predicted = models.risk_forecast(days, rounds=5)
    mean = {r["gy"]: r["p"] for r in predicted.groupBy("gy").agg(F.avg("pred").alias("p")).collect()}
    assert mean[1075] > 2 * mean[1083] and predicted.filter("pred < 0").count() == 0
