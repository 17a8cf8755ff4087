"""Any city box, dirty endpoints, session zones, many causes, CSV with line breaks."""

import random

import pytest
from pyspark.sql import functions as F

from kerbwise.functions.geo import distance_pairs
from kerbwise.operators import barricade, bursts, models, network
from kerbwise.operators.cleaning import clean
from kerbwise.operators.impact import enrich
from kerbwise.settings import PAIR_WINDOW_SEC, SPILL_KM, Bounds
from kerbwise.sources import incidents, sinks
from tests.helpers import distance, raw


@pytest.mark.parametrize("latitude", [0.0, 55.0, -34.0, 80.0])
def test_distance_pairs_are_complete_at_any_latitude(spark, latitude):
    r = random.Random(int(latitude))
    points = [(i, latitude + r.uniform(-0.3, 0.3), 20 + r.uniform(-0.8, 0.8)) for i in range(150)]
    left = spark.createDataFrame(points, "i long, lat double, lon double")
    right = left.withColumnRenamed("i", "j")
    found = {(x.i, x.j) for x in distance_pairs(left, right, 8.0).collect()}
    assert found == {(a[0], b[0]) for a in points for b in points if distance(a[1:], b[1:]) <= 8.0}


@pytest.mark.parametrize("latitude", [0.0, 55.0, -34.0])
def test_follow_on_pairs_are_complete_at_any_latitude(spark, latitude):
    r = random.Random(int(latitude) + 1)
    rows = [
        {
            "latitude": str(latitude + r.uniform(-0.2, 0.2)), "longitude": str(20 + r.uniform(-0.2, 0.2)), "corridor": r.choice("ABC"),
            "created_date": f"2024-01-01 {r.randrange(6, 12):02}:{r.randrange(60):02}:{r.randrange(60):02}+00",
        }
        for _ in range(80)
    ]
    df = clean(raw(spark, rows), Bounds(latitude - 1, latitude + 1, 19, 21))
    seen = [(x.t, x.lat, x.lon, x.corridor) for x in df.select(F.unix_seconds("t_event").alias("t"), "lat", "lon", "corridor").collect()]
    want = sum(
        a[3] != b[3] and 0 <= b[0] - a[0] <= PAIR_WINDOW_SEC and (b[0] > a[0] or b[3] > a[3]) and distance(a[1:3], b[1:3]) <= SPILL_KM
        for a in seen for b in seen
    )
    assert network.spillover_pairs(df).agg(F.sum("count")).first()[0] == want > 0
    sizes = sum(0 <= b[0] - a[0] <= PAIR_WINDOW_SEC and distance(a[1:3], b[1:3]) <= 1.5 for a in seen for b in seen)
    assert bursts.burst_neighbours(df).agg(F.sum("size")).first()[0] == sizes


@pytest.mark.parametrize("stray", ["1e9", "Infinity", "NaN", "-200", "x"])
def test_stray_endpoints_are_no_endpoints(spark, stray):
    df = enrich(raw(spark, [{"requires_road_closure": "TRUE", "endlatitude": stray, "endlongitude": "77.61"},
                            {"requires_road_closure": "TRUE", "endlatitude": "12.99", "endlongitude": stray},
                            {"requires_road_closure": "TRUE", "endlatitude": "12.99", "endlongitude": "77.61"}]))
    assert barricade.approach_points(df).groupBy("kind").count().orderBy("kind").collect() == [(0, 3), (1, 1)]
    assert barricade.barricade_zones(df).agg(F.sum("approaches")).first()[0] == 4


def test_dates_do_not_depend_on_the_session_zone(spark):
    found = set()
    for zone in ("America/New_York", "Asia/Tokyo", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = clean(raw(spark, [{"created_date": "2024-01-01 20:00:00+00"}]))
        found.add(tuple(df.select("dow", F.col("date").cast("string"), "daypart", F.unix_seconds("t_event")).first()))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == {(1, "2024-01-02", "night", 1704139200)}


def test_clearance_forest_takes_any_number_of_causes(spark):
    r = random.Random(9)
    rows = [
        {"event_cause": f"cause {i % 45}", "created_date": f"2024-{1 + i % 4:02}-{1 + i % 27:02} 06:00:00+00",
         "resolved_datetime": f"2024-{1 + i % 4:02}-{1 + i % 27:02} {7 + (i % 45) // 5:02}:{r.randrange(60):02}:00+00"}
        for i in range(1800)
    ]
    got = models.clearance_table(enrich(raw(spark, rows))).collect()
    assert len(got) == 45 and all(x.p50_min <= x.p90_min for x in got)


def test_csv_keeps_breaks_quotes_and_column_order(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"', "a,b"), (2, None, ""), (3, "back\\slash", "'")]
    df = spark.createDataFrame(rows, "i int, text string, other string")
    back = sinks.write_table(df, str(tmp_path / "t"), format="csv")
    assert sorted(map(tuple, back.collect())) == rows
    names = list(incidents.RAW_COLUMNS)
    for k, order in enumerate((names, names[::-1])):
        lines = [",".join(order), ",".join(f'"{n}\nof {k}"' for n in order)]
        (tmp_path / f"log{k}.csv").write_text("\n".join(lines) + "\n")
    one = [incidents.scan_csv(spark, str(tmp_path / f"log{k}.csv")).collect() for k in (0, 1)]
    assert [tuple(x[0]) for x in one] == [tuple(f"{n}\nof {k}" for n in names) for k in (0, 1)]
    with pytest.raises(Exception, match="header"):  # files of one scan must agree; no row goes to a wrong column
        incidents.scan_csv(spark, [str(tmp_path / "log0.csv"), str(tmp_path / "log1.csv")]).collect()
