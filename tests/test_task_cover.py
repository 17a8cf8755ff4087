"""Greedy placement: a task per partition picks what rounds over all tasks pick."""

import random
import uuid

from pyspark.sql import functions as F

from kerbwise.operators import cover


def cells_of(spark, twice=0):
    r = random.Random(11)
    place = {(gy, gx): (gy * 0.012 + r.uniform(-0.005, 0.005), gx * 0.012 + r.uniform(-0.005, 0.005)) for gy in range(1072, 1081) for gx in range(6450, 6459)}
    rows = [(d, s, gy, gx, *at, float(r.choice([0, 0.1, 5, 5, 17.25, r.random()]))) for d in range(4) for s in "ab" for (gy, gx), at in place.items() if r.random() < 0.8]
    rows += rows[:twice]
    rows += [(9, "a", 1072, 6450, 12.9, 77.4, 3.0), (None, "a", 1072, 6450, 12.9, 77.4, 3.0), (1, "a", None, 6450, 12.9, 77.4, 3.0)]
    return spark.createDataFrame(rows, "dow int, s string, gy int, gx int, lat double, lon double, w double").repartition(5)


def test_tasks_pick_what_rounds_pick(spark):
    def both(cells, parts, units, **more):
        one, rounds = (cover.greedy_cover(cells, parts, units, task_cells=n, **more) for n in (10**6, 0))
        assert one.dtypes == rounds.dtypes
        got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (one, rounds))
        assert got == want and len(got) > units
        return got

    cells = cells_of(spark).filter("gy is null or dow is null or dow = 9 or gy <> 1072 or gx <> 6450")
    both(cells, ["dow", "s"], 4, minsep_km=1.8)
    both(cells, ["dow"], 3, minsep_km=2.5, order=[F.col("lat"), F.col("gy"), F.col("gx")])
    few = cells.filter("gy < 1074 and gx < 6452 or dow = 9")
    assert {r[0] for r in both(few, ["dow", "s"], 6)} == {0, 1, 2, 3, 9}  # more units than cells
    both(cells_of(spark, twice=40).filter("dow < 2 and s = 'a' and (gy <> 1072 or gx <> 6450)"), ["dow"], 4)  # cells that come twice


def test_placement_is_not_a_job_per_unit(spark):
    cells = cells_of(spark).filter("dow < 4").cache()
    cells.count()
    context, group = spark.sparkContext, f"cover-{uuid.uuid4().hex}"
    context.setJobGroup(group, "cover")
    try:
        assert cover.greedy_cover(cells, ["dow", "s"], 10).count() == 80
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup(group)) < 30  # was some seven a unit
