"""Figures of a neighbourhood: summed up where they are compared, equal to those from a row per cause."""

import datetime as dt
import random

from pyspark.sql import functions as F

from kerbwise.operators import bursts, neighbours


def test_figures_equal_those_of_rows_per_cause(spark):
    r = random.Random(2)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    causes = ["accident", "debris", "pot_holes", "protest", "others", "tree_fall", None]
    rows = []
    for i in range(500):
        when = start + dt.timedelta(seconds=300 * r.randrange(500)) if i % 50 else None
        rows.append((f"E{i}", when, 12.9 + r.randrange(8) * 0.006, 77.6 + r.randrange(8) * 0.006, r.choice(causes)))
    rows += [("N", start - dt.timedelta(days=9), 13.1, 77.5, None), ("A", start - dt.timedelta(days=9), 13.2, 77.4, "accident")]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "id string, t_event timestamp, lat double, lon double, cause string").repartition(4)
    here = bursts.neighbourhoods(df)
    moved = bursts.neighbourhoods(df, pair_limit=0)  # every box is crowded: rows per cause are added up
    apart = bursts.cause_neighbours(df).groupBy(*neighbours.PLACE_TIME).agg(*bursts.neighbourhood_figures())
    assert here.dtypes == moved.dtypes == apart.dtypes
    got, *want = (sorted(map(tuple, f.collect()), key=repr) for f in (here, moved, apart))
    assert got == want[0] == want[1] and len(got) > 200
    assert {row[-1] for row in got} == {True, False, None} and max(row[3] for row in got) > 10


def test_no_row_per_cause_moves(spark):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("t_event"),
        F.lit(12.9).alias("lat"), F.lit(77.6).alias("lon"), F.concat(F.lit("cause "), F.col("id") % 40).alias("cause"),
    )
    found = bursts.neighbourhoods(df)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert found.count() == 200
