"""Boosting: the stop rule, vectors against the panel they stand for, folds that know only their past."""

from pyspark.sql import functions as F

from kerbwise.operators import models, surface
from kerbwise.operators.impact import enrich
from kerbwise.sources.event_log import scan_events


def test_stop_rule():
    falling = [10.0 - i / 100 for i in range(30)]
    assert models.chosen_rounds(falling) is None
    assert models.chosen_rounds([5.0] * 10) is None and models.chosen_rounds([5.0] * 11) == 1
    assert models.chosen_rounds([5.0] * 10 + [4.0]) is None and models.chosen_rounds([4.0] + [5.0] * 10) == 1
    late = [9.0, 8.0, 7.0] + [7.5] * 5 + [6.0] + [6.5] * 10 + [1.0]  # one gain within ten rounds goes on, none ends it
    assert models.chosen_rounds(late) == 9
    assert models.chosen_rounds([1.0 - 0.001 * i for i in range(12)]) is None  # gains of a thousandth are not given up


def days_of(spark, sf_dir):
    return surface.cell_days(enrich(scan_events(spark, sf_dir)))


def test_vectors_sum_the_panel(spark, sf_dir):
    days = days_of(spark, sf_dir)
    panel = surface.cell_date_panel(days)
    start = days.select(surface.holdout_start(days).alias("d")).first().d
    cells = panel.select(F.lit(0).alias("fold"), "gy", "gx", "lat", "lon", "hist_n", "hist_rate", "crit").distinct()
    key = ["gy", "gx", "dow", "month"]
    got = {tuple(r[k] for k in key): (r.n, round(r.y, 6), round(r.yy, 3)) for r in models.vectors(days, cells, [(0, start)]).collect()}
    training = F.col("date") < F.lit(start)
    own = panel.groupBy(*key).agg(F.count_if(training).alias("n"), F.sum(F.when(training, F.col("y")).otherwise(0)).alias("y"),
                                  F.sum(F.when(training, F.col("y") * F.col("y")).otherwise(0)).alias("yy"))
    assert got == {tuple(r[k] for k in key): (r.n, round(r.y, 6), round(r.yy, 3)) for r in own.collect()}


def test_weights_stand_for_rows(spark):
    rows = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(3).alias("n"),
        (3 * ((F.col("id") % 20 > 9).cast("double") * 10 + F.col("id") % 7)).alias("y"), (F.col("id") % 10 == 0).alias("held"),
    )
    scored = models.predict(rows, *models.fit_risk(rows, ["a", "b"], 15))
    assert scored.agg(F.max(F.abs(F.col("pred") - F.col("y") / 3))).first()[0] < 2.5
    none = models.predict(rows, *models.fit_risk(rows.withColumn("held", F.lit(False)), ["a", "b"], 4))
    assert none.count() == 400


def test_forecast_and_walk_forward(spark, sf_dir):
    days = days_of(spark, sf_dir)
    predicted = models.risk_forecast(days, rounds=3)
    assert predicted.count() == surface.cell_date_panel(days).count() and predicted.filter("pred is null or pred < 0").isEmpty()
    early = days.filter(F.col("date") < F.date_add(surface.first_day(days), 75))
    scored = models.walk_forward_scores_model(early, rounds=2)
    weeks = models.walk_forward(scored).collect()
    assert weeks and [w.week for w in weeks] == list(range(1, len(weeks) + 1)) and all(0 <= w.capture <= 100 for w in weeks)
    fold = scored.agg(F.min("fold").alias("f")).first().f
    start = scored.filter(F.col("fold") == fold).agg(F.min("date").alias("d")).first().d
    known = days.filter(F.col("date") < F.lit(start)).groupBy("gy", "gx").agg(F.sum("n").alias("n")).filter("n >= 5")
    cells = models.fold_cells(early, fold + 1).filter(F.col("fold") == fold)
    assert sorted((r.gy, r.gx, r.hist_n) for r in cells.collect()) == sorted((r.gy, r.gx, r.n) for r in known.collect())
